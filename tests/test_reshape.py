import pytest
from pyspark.sql import functions as F

from sifter.operators import reshape
from tests.conftest import canon


def test_feature_metrics_and_normalise(spark):  # FX1
    c = canon(spark, [("cust-001", "2026-03-15T12:00:00", (10.0, 2)),
                      ("cust-002", "2026-03-15T12:05:00", (20.0, 4))])
    flat = reshape.derived_metrics(reshape.flatten(c))
    rows = flat.orderBy("entity_id").collect()
    assert [r["feature_count"] for r in rows] == [2, 2]
    assert [r["feature_sum"] for r in rows] == [12.0, 24.0]
    norm = reshape.minmax_normalise(flat).orderBy("entity_id").collect()
    assert [r["amount"] for r in norm] == [0.0, 1.0]
    assert [r["count"] for r in norm] == [0.0, 1.0]
    assert [r["feature_sum"] for r in norm] == [12.0, 24.0]


def test_constant_column_normalises_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, None)], "a double, b double")
    out = reshape.minmax_normalise(df).collect()
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0]


def test_adapter_roles_and_canonical(spark):  # FX12
    raw = spark.createDataFrame([(1, "Alice", 120.5, "2026-01-01")],
                                " Customer_ID int, Customer_Name string, Order_Amount double, "
                                "Order_Date string")
    c = reshape.adapt(raw)
    assert c.columns == ["entity_id", "timestamp", "features", "metadata"]
    assert reshape.feature_names(c) == ["customer_name", "order_amount"]
    r = reshape.first_numeric_value(c).first()
    assert r["value"] == 120.5 and r["entity_id"] == 1 and r["timestamp"] == "2026-01-01"


def test_roles_substring_rule():  # T3
    roles = reshape.classify_columns(["width", "paid_date", "start_time", "amount", "user_id"])
    assert roles.entity == ["width", "paid_date", "user_id"]  # "id" inside "paid"
    assert roles.timestamp == ["start_time"]
    assert roles.features == ["amount"]


def test_adapter_errors(spark):
    with pytest.raises(ValueError, match="entity_id"):
        reshape.adapt(spark.createDataFrame([(1, "x")], "amount int, order_date string"))
    with pytest.raises(ValueError, match="timestamp"):
        reshape.adapt(spark.createDataFrame([(1, "x")], "cust_id int, name string"))


def test_timestamp_rendering(spark):  # FX9
    import datetime as dt
    df = spark.createDataFrame([(1, dt.datetime(2026, 3, 15, 12, 30, 45)),
                                (2, dt.datetime(2026, 3, 15, 12, 30, 45, 120))],
                               "id int, event_time timestamp")
    out = [r["timestamp"] for r in reshape.adapt(df).orderBy("entity_id").collect()]
    assert out == ["2026-03-15T12:30:45", "2026-03-15T12:30:45.000120"]


def test_first_numeric_value_strings_and_nan(spark):
    c = canon(spark, [("a", "t", ("n/a", float("nan"), " 7 ")), ("b", "t", ("1e2", 3.0, None)),
                      ("c", "t", (None, None, "x"))], "s string, d double, t string")
    out = {r["entity_id"]: r["value"] for r in reshape.first_numeric_value(c).collect()}
    assert out == {"a": 7.0, "b": 100.0, "c": None}


def test_feature_dataset_counts(spark):
    recs = spark.createDataFrame([("a", "t", "1.5", "1"), ("", "t", "2", None),
                                  (None, "t", "x", "3.7"), ("d", "t", None, "0")],
                                 "entity_id string, timestamp string, value string, label string")
    typed, counts = reshape.feature_dataset(recs)
    c = counts.first()
    assert (c["total_records"], c["valid_records"], c["invalid_records"]) == (4, 1, 3)
    labels = [r["label"] for r in typed.collect()]
    assert labels == [1, None, None, 0]


def test_keep_usable_falls_back(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "entity_id string, value double")
    assert reshape.keep_usable(df).count() == 2
    df2 = spark.createDataFrame([("a", 1.0), ("b", None)], "entity_id string, value double")
    assert reshape.keep_usable(df2).count() == 1


def test_field_resolution():  # B18
    r = reshape.resolve_fields(["entity_id", "timestamp", "Sales", "profit", "Order_Date", "CATEGORY"])
    assert r == {"Sales": "Sales", "Profit": "profit", "Category": "CATEGORY",
                 "Order Date": "Order_Date"}
    assert reshape.resolve_fields(["timestamp", "sales"])["Order Date"] == "timestamp"
    ctx = reshape.chart_context(["sales", "quantity"])
    assert ctx["scatter"] == {"target_variable": "Sales", "compare_variable": "Quantity"}
