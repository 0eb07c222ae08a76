import datetime as dt

import pytest
from pyspark.sql import functions as F

from sifter.operators import charts, profile, reshape
from sifter.plans.pipeline import chart_data

FX10 = [("A", "2026-01-01", 10.0, 8.0, 1, 0.0, "X"), ("B", "2026-01-02", 20.0, 18.0, 2, 0.1, "Y"),
        ("C", "2026-01-03", 15.0, 12.0, 3, 0.0, "X"), ("D", "2026-01-04", 30.0, 25.0, 4, 0.2, "Z")]


@pytest.fixture()
def fx10(spark):
    df = spark.createDataFrame(FX10, "entity_id string, timestamp string, sales double, "
                               "profit double, quantity long, discount double, category string")
    return df


def test_chart_aggregates(spark, fx10):  # FX10
    af = reshape.analysis_frame(fx10)
    gm = {r["key"]: r["mean"] for r in charts.grouped_mean(af, "Sales", "Category").collect()}
    assert gm == {"X": 12.5, "Y": 20.0, "Z": 30.0}
    cc = [(r["value"], r["count"]) for r in charts.category_counts(af, "Category").collect()]
    assert cc == [("X", 2), ("Y", 1), ("Z", 1)]
    h = charts.histogram(af, "Sales").collect()
    assert [r["count"] for r in h] == [1, 0, 1, 0, 0, 1, 0, 0, 0, 1]
    assert h[0]["lower"] == 10.0 and h[-1]["upper"] == 30.0
    b = charts.box_stats(af, "Sales").first()
    assert (b["q1"], b["median"], b["q3"]) == (13.75, 17.5, 22.5)
    assert (b["whisker_low"], b["whisker_high"], b["outliers"]) == (10.0, 30.0, 0)
    assert charts.daily_mean(af, "Sales", "Order Date").count() == 4
    gb = {r["key"]: r for r in charts.grouped_box_stats(af, "Sales", "Category").collect()}
    assert gb["X"]["median"] == 12.5 and gb["Z"]["n"] == 1


def test_histogram_constant_series(spark):  # T12
    af = spark.createDataFrame([(5.0,), (5.0,)], "Sales double")
    h = charts.histogram(af, "Sales").collect()
    assert h[5]["count"] == 2 and h[0]["lower"] == 4.5 and h[-1]["upper"] == 5.5


def test_box_outliers_and_whiskers(spark):  # T13
    af = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "Sales double")
    b = charts.box_stats(af, "Sales").first()
    assert b["whisker_high"] == 4.0 and b["outliers"] == 1
    assert [r[0] for r in charts.box_outliers(af, "Sales", charts.box_stats(af, "Sales")).collect()] == [100.0]


def test_overview(spark):  # FX11
    df = spark.createDataFrame(
        [("1", "2026-01-01", 100.0, 20.0, "Furniture"),
         ("2", "2026-01-02", 200.0, None, "Office Supplies"),
         ("3", "2026-01-03", None, 15.0, "Furniture")],
        "entity_id string, timestamp string, sales double, profit double, category string")
    ov = profile.overview(df)
    assert ov["fields"] == ["Sales", "Profit", "Category", "Order Date"]
    assert tuple(ov["shape"].first()) == (3, 5, 4)
    miss = {r["column"]: r["missing"] for r in ov["missing_by_column"].collect()}
    assert miss["Sales"] == 1 and miss["Profit"] == 1
    ns = {r["field"]: r for r in ov["numeric_summary"].collect()}
    assert ns["Sales"]["mean"] == 150.0 and ns["Sales"]["median"] == 150.0
    assert ns["Sales"]["std"] == 70.7107
    ds = ov["date_summary"].first()
    assert (ds["min_date"], ds["max_date"], ds["count"]) == ("2026-01-01", "2026-01-03", 3)
    cs = ov["categorical_summary"].first()
    assert cs["unique"] == 2
    assert ov["top_values"].first()["value"] == "Furniture"
    ts = ov["target_stats"].first()
    assert (ts["min"], ts["max"], ts["count"]) == (100.0, 200.0, 2)


def test_label_encoding_and_scatter(spark):  # B21, B22
    df = spark.createDataFrame([(0, 1.0, "b"), (1, 2.0, None), (2, 3.0, "a"), (3, None, "b"),
                                (4, 5.0, "a")], "record_index long, x double, c string")
    enc = {r["c"]: r["c_code"] for r in charts.label_encode(df, "c").collect()}
    assert enc == {"b": 0, None: 1, "a": 2}
    pairs = charts.scatter_pairs(df, "x", "c").orderBy("record_index").collect()
    assert [(r["x"], r["y"]) for r in pairs] == [(1.0, 0), (2.0, 1), (3.0, 2), (5.0, 2)]


def test_thinned_labels(spark):  # G6
    days = spark.createDataFrame([(f"d{i:02d}",) for i in range(30)], "day string")
    out = charts.thinned_labels(days, "day", ["day"]).orderBy("position").collect()
    vis = [r["position"] for r in out if r["visible"]]
    assert vis == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 29]
    long = spark.createDataFrame([("a" * 30,)], "l string")
    assert charts.thinned_labels(long, "l", ["l"]).first()["short_label"] == "a" * 17 + "…"


def test_chart_data_errors(spark, fx10):  # K6
    with pytest.raises(ValueError, match="compare variable"):
        chart_data(fx10, "bar-category", compare="Nope")
    with pytest.raises(ValueError, match="Order Date"):
        chart_data(fx10, "time-line", compare="Profit")
    assert chart_data(fx10, "scatter", compare="Category").count() == 4
    assert chart_data(fx10, "time-line", compare="Order Date").count() == 4
    empty = fx10.withColumn("sales", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="grouped-boxplot"):
        chart_data(empty, "grouped-boxplot", compare="Category")
    with pytest.raises(ValueError, match="time-line"):
        chart_data(empty, "time-line", compare="Order Date")


def test_relationship_sweep(spark, fx10):  # E15
    af = reshape.analysis_frame(fx10).withColumn("record_index", F.monotonically_increasing_id())
    out = charts.relationship_sweep(af, "Sales", ["Profit", "Category", "Order Date"])
    assert out["scatter"].select("variable").distinct().count() == 3
    assert out["daily_line"].count() == 4
    assert out["grouped_box"].where("variable = 'Category'").count() == 3
