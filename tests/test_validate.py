from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.order import with_ordinal
from sifter.operators import validate
from tests.conftest import canon


def test_valid_and_missing_keys(spark):  # FX5, FX6
    c = canon(spark, [("cust-001", "2026-03-15T12:00:00", (100.0, 1)),
                      (None, "2026-03-15T12:00:00", (100.0, 1)),
                      ("cust-003", None, (100.0, 1))])
    out = validate.validate(c).collect()
    assert [r["status"] for r in out] == ["valid", "invalid", "invalid"]
    assert [r["errors"] for r in out] == [[], ["Missing entity_id"], ["Missing timestamp"]]


def test_features_not_a_dictionary(spark):  # FX6
    df = spark.createDataFrame([("a", "t", [1.0], {})], "entity_id string, timestamp string, "
                               "features array<double>, metadata map<string,string>")
    assert validate.validate(df).first()["errors"] == ["Features must be a dictionary"]


def test_nan_entity_is_missing(spark):  # T1
    df = spark.createDataFrame([(float("nan"), "t", (1.0,), {})],
                               "entity_id double, timestamp string, features struct<a:double>, "
                               "metadata map<string,string>")
    assert validate.validate(df).first()["errors"] == ["Missing entity_id"]


def test_duplicates(spark):  # FX7
    c = canon(spark, [("cust-001", "2026-03-15T12:00:00", (1.0, 1)),
                      ("cust-001", "2026-03-15T12:00:00", (2.0, 1)),
                      (None, "2026-03-15T12:00:00", (1.0, 1)),
                      (None, "2026-03-15T12:00:00", (1.0, 1))])
    c = c.withColumn("record_index", F.monotonically_increasing_id())
    c = with_ordinal(c.drop("record_index").withColumn("_o", F.monotonically_increasing_id()),
                     ["_o"]).drop("_o")
    d = validate.duplicates(c).collect()
    assert [(r["record_index"], r["entity_id"]) for r in d] == [(1, "cust-001")]


def test_batch_and_reports(spark):
    c = canon(spark, [("a", "t1", (1.0, 1)), ("a", "t1", (1.0, 1)), (None, "t2", (1.0, 1))])
    c = with_ordinal(c.withColumn("_o", F.monotonically_increasing_id()), ["_o"]).drop("_o")
    totals, rows = validate.batch_validation(c)
    t = totals.first()
    assert (t["total_records"], t["valid_records"], t["invalid_records"], t["status"]) == \
        (3, 2, 1, "invalid")
    assert [(r["record_index"], r["errors"]) for r in rows.collect()] == [(2, ["Missing entity_id"])]
    rep = validate.quality_report(totals, validate.duplicates(c)).first()
    assert rep["duplicate_records"] == 1 and rep["warnings"] == ["Duplicate records detected"]
    reasons = validate.invalid_reason_counts(validate.validate(c)).collect()
    assert [(r["reason"], r["count"]) for r in reasons] == [("Missing entity_id", 1)]


def test_timestamp_errors(spark):  # C5
    vals = ["2026-03-15T12:30:45", "2026-03-15", "2026-03-15 12:30", "20260315", "2026-3-1",
            "nonsense", None, "2026-03-15T12:30:45.123Z", "2026-02-30"]
    df = spark.createDataFrame([(v,) for v in vals], "ts string")
    out = [r[0] for r in df.select(validate.timestamp_errors("ts", T.StringType())).collect()]
    assert out == [[], [], [], ["Invalid timestamp format"], ["Invalid timestamp format"],
                   ["Invalid timestamp format"], ["Missing timestamp"], [],
                   ["Invalid timestamp format"]]


def test_feature_errors(spark):  # C6
    c = canon(spark, [("a", "t", (None, 2)), ("b", "t", (1.0, None)), ("c", "t", None)])
    out = [r[0] for r in c.select(validate.feature_errors(c)).collect()]
    assert out == [["Feature 'amount' is missing a value"],
                   ["Feature 'count' is missing a value"], ["Missing features"]]


def test_entity_lookup_and_filters(spark):
    c = canon(spark, [("1", "t", (1.0, 1)), ("2", "t", (1.0, 1))])
    assert validate.entity_lookup(c, 1).count() == 1
    num = spark.createDataFrame([(1, "t"), (2, "t")], "entity_id long, timestamp string")
    plan = validate.entity_lookup(num, "2")
    assert plan.count() == 1
    pred = spark.createDataFrame([("a", "t1", 1.0), ("future", "t+1", 2.0)],
                                 "entity_id string, timestamp string, value double")
    fut, counts = validate.future_rows(pred)
    assert fut.count() == 1 and tuple(counts.first()) == (2, 1)


def test_sanitize(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.23456,)], "x double")
    assert [r[0] for r in validate.sanitize(df, 4).collect()] == [None, None, 1.2346]
