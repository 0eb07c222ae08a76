import pytest
from pyspark.sql import functions as F

from sifter.operators import forecast, metrics


def _series(spark, values):
    return spark.createDataFrame([(i, str(i), f"t{i}", v) for i, v in enumerate(values)],
                                 "k long, entity_id string, timestamp string, value double")


def test_linear_trend(spark):  # FX24
    s = _series(spark, [10.0, float("nan"), 20.0, None, 30.0])
    out = forecast.linear_trend(s, ["k"], steps=2).collect()
    assert [r["value"] for r in out] == [10.0, 20.0, 30.0, 40.0, 50.0]
    assert [r["timestamp"] for r in out] == ["t0", "t2", "t4", "t+1", "t+2"]
    with pytest.raises(ValueError):
        forecast.linear_trend(_series(spark, [1.0]), ["k"])
    assert forecast.linear_trend(_series(spark, [None]), ["k"]).count() == 0


def test_moving_average(spark):  # FX25
    s = _series(spark, [100.0, float("nan"), 110.0, float("nan"), 105.0])
    out = forecast.moving_average(s, ["k"], steps=3, window=2).collect()
    fut = [r["value"] for r in out if r["entity_id"] == "future"]
    assert fut == [107.5, 106.25, 106.875]
    assert len(out) == 8
    one = forecast.moving_average(_series(spark, [4.0]), ["k"], steps=2, window=3).collect()
    assert [r["value"] for r in one] == [4.0, 4.0, 4.0]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "value double, prediction double")
    r = metrics.regression_metrics(df).first()
    assert (r["mae"], r["mse"], r["rmse"], r["r2"], r["support"]) == (0.3333, 0.3333, 0.5774, 0.5, 3)
    e = metrics.regression_metrics(df.limit(0)).first()
    assert e["mae"] is None and e["support"] == 0


def test_classification_metrics(spark):
    df = spark.createDataFrame([(1, True), (0, True), (1, False), (0, False), (None, True)],
                               "label int, is_anomaly boolean")
    r = metrics.classification_metrics(df).first()
    assert (r["true_positives"], r["false_positives"], r["true_negatives"], r["false_negatives"]) == (1, 1, 1, 1)
    assert (r["precision"], r["recall"], r["f1_score"], r["support"]) == (0.5, 0.5, 0.5, 4)


def test_roc_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, anomaly_score double")
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.75
    ties = spark.createDataFrame([(0, 1.0), (1, 1.0)], "label int, anomaly_score double")
    assert metrics.roc_auc(ties).first()["roc_auc"] == 0.5
    one = spark.createDataFrame([(1, 1.0), (1, 2.0)], "label int, anomaly_score double")
    assert metrics.roc_auc(one).first()["roc_auc"] is None
    inv = metrics.roc_auc(df, higher_is_anomalous=False).first()["roc_auc"]
    assert inv == 0.25


def test_model_comparison(spark):
    a = spark.createDataFrame([(0.5,)], "precision double")
    out = metrics.model_comparison("anomaly", {"m1": a, "m2": a}).collect()
    assert [(r["model_type"], r["model"]) for r in out] == [("anomaly", "m1"), ("anomaly", "m2")]
