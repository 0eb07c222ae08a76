from pyspark.sql import functions as F

from sifter.operators import anomaly, reshape
from tests.conftest import canon


def _records(spark, values):
    return spark.createDataFrame([(str(i), f"t{i}", v) for i, v in enumerate(values)],
                                 "entity_id string, timestamp string, value double")


def test_iqr_detect(spark):  # FX2
    c = canon(spark, [(f"cust-00{i + 1}", "2026-03-15T12:00:00", (float(a), 1))
                      for i, a in enumerate([10, 11, 12, 13, 100])])
    out = anomaly.severity(anomaly.iqr_detect(reshape.flatten(c))).orderBy("entity_id").collect()
    flagged = [r["entity_id"] for r in out if r["is_anomaly"]]
    assert flagged == ["cust-005"]
    r = out[-1]
    assert r["anomaly_score"] == 2.0 and r["severity"] == "high" and r["alert"] == "ALERT"


def test_severity_ladder(spark):  # FX3
    df = spark.createDataFrame([(0.0, False), (1.0, True), (2.0, True), (3.0, True)],
                               "anomaly_score double, is_anomaly boolean")
    out = anomaly.severity(df).collect()
    assert [r["severity"] for r in out] == ["low", "medium", "high", "critical"]
    assert [r["alert"] for r in out] == ["OK", "ALERT", "ALERT", "ALERT"]
    custom = anomaly.severity(df, {"low": 0.5, "medium": 5, "high": 10}).collect()
    assert [r["severity"] for r in custom] == ["low", "medium", "medium", "medium"]


def test_evaluation(spark):  # FX4
    df = spark.createDataFrame([(0.0, False, "low"), (1.0, True, "medium"), (3.0, True, "critical")],
                               "anomaly_score double, is_anomaly boolean, severity string")
    e = anomaly.evaluation(df).first()
    assert (e["total_records"], e["anomaly_count"]) == (3, 2)
    assert abs(e["anomaly_rate"] - 2 / 3) < 1e-12
    dist = [(r["score"], r["count"]) for r in anomaly.score_distribution(df).collect()]
    assert dist == [("0.0", 1), ("1.0", 1), ("3.0", 1)]
    sev = {r["severity"]: r["count"] for r in anomaly.severity_breakdown(df).collect()}
    assert sev == {"low": 1, "medium": 1, "critical": 1}
    empty = anomaly.evaluation(df.limit(0)).first()
    assert (empty["total_records"], empty["anomaly_count"], empty["anomaly_rate"]) == (0, 0, 0.0)


def test_zscore(spark):  # FX21, FX22
    recs = _records(spark, [10.0, 11.0, 12.0, 13.0, 80.0])
    out = anomaly.ZScoreModel(threshold=1.5).fit(recs).transform(recs).collect()
    assert [r["is_anomaly"] for r in out] == [False] * 4 + [True]
    assert out[-1]["anomaly_score"] == 1.9987
    out2 = anomaly.ZScoreModel(threshold=2.0).fit(recs).transform(recs)
    assert out2.where("is_anomaly").count() == 0
    nan = _records(spark, [10.5, float("nan"), 20.3, float("nan"), 15.8])
    res = anomaly.ZScoreModel(1.5).fit(nan).transform(nan).collect()
    assert [r["anomaly_score"] is None for r in res] == [False, True, False, True, False]
    const = _records(spark, [3.0, 3.0])
    assert anomaly.ZScoreModel().fit(const).transform(const).where("is_anomaly").count() == 0


def test_threshold_and_summary(spark):
    recs = _records(spark, [1.0, 5.0, None, 7.0])
    out = anomaly.ThresholdModel(threshold=5.0).transform(recs)
    assert [r["is_anomaly"] for r in out.collect()] == [False, False, False, True]
    s = anomaly.detector_summary(out).first()
    assert (s["total_records"], s["anomaly_count"]) == (4, 1)


def test_fences_one_column(spark):  # J4, E30
    df = spark.createDataFrame([(float(v),) for v in [10, 11, 12, 13, 100]], "amount double")
    flagged, fences = anomaly.column_fence_flags(df, "amount")
    assert fences == (8.0, 16.0)
    assert flagged.where("is_anomaly").count() == 1
