import os

import pytest
from pyspark.sql import functions as F

from sifter.plans import pipeline
from sifter.sources import store


def _csv(tmp_dir):
    p = os.path.join(tmp_dir, "sales.csv")
    with open(p, "w") as f:
        f.write("customer_id,order_date,sales,profit,category\n"
                "1,2026-01-01,100,20,Furniture\n"
                ",2026-01-02,300,40,Office Supplies\n"
                "3,2026-01-05,500,,Technology\n")
    return p


def test_pipeline_success(spark, tmp_dir):  # K1
    src = _csv(tmp_dir)
    out = os.path.join(tmp_dir, "store")
    runs = os.path.join(tmp_dir, "runs")
    s = pipeline.run_pipeline(spark, src, out, "csv", summary_path=runs)
    assert s.status == "SUCCESS"
    assert (s.records_ingested, s.records_valid, s.records_invalid, s.records_persisted) == (3, 2, 1, 2)
    assert store.load(spark, out).count() == 2
    assert store.last_run_summary(spark, runs).first()["records_valid"] == 2
    recs, counts = pipeline.model_ready(spark, out)
    assert counts.first().asDict() == {"total_records": 2, "valid_records": 2, "invalid_records": 0}
    assert sorted(r["value"] for r in recs.collect()) == [100.0, 500.0]


def test_pipeline_failing_stage(spark, tmp_dir):  # K1 failure path
    def boom(stage):
        if stage == "persistence":
            raise RuntimeError("disk full")
    s = pipeline.run_pipeline(spark, _csv(tmp_dir), os.path.join(tmp_dir, "s"), "csv", stage_hook=boom)
    assert s.status == "FAILED" and s.failed_stage == "persistence"
    assert s.records_persisted == 0 and s.error_message == "disk full"


def test_cleaning_audit(spark):  # FX15
    rows = [("1", "2026-01-01", 100.0, 20.0, "Furniture"), ("1", "2026-01-01", 100.0, 20.0, "Furniture"),
            ("2", None, 300.0, 40.0, "Office Supplies"), ("3", "2026-01-05", 500.0, None, "Technology")]
    schema = "id string, order_date string, sales double, profit double, category string"
    from sifter.operators import reshape
    before = reshape.adapt(spark.createDataFrame(rows, schema))
    after = reshape.adapt(spark.createDataFrame(
        [("1", "2026-01-01", 100.0, 20.0, "Furniture"), ("2", "2026-01-02", 300.0, 40.0, "Office Supplies")],
        schema))
    a = {(r["metric"], r["field"]): (r["before"], r["after"])
         for r in pipeline.cleaning_audit(before, after).collect()}
    assert a[("rows", "")] == (4, 2)
    assert a[("duplicates", "")] == (1, 0)
    assert a[("invalid_rows", "")] == (1, 0)
    assert a[("invalid_reason", "Missing timestamp")] == (1, 0)
    assert a[("valid_rows", "")] == (3, 2)
    assert a[("missing", "timestamp")] == (1, 0) and a[("missing", "profit")] == (1, 0)


def test_detect_and_predict(spark):  # K4, K5
    recs = spark.createDataFrame([(i, str(i), f"t{i}", float(v)) for i, v in
                                  enumerate([10, 11, 12, 13, 80])],
                                 "k long, entity_id string, timestamp string, value double")
    rows, summary, ctx = pipeline.detect(recs, "zscore", threshold=1.5)
    assert summary.first()["anomaly_count"] == 1 and ctx["value"] == "value"
    rows, summary, ctx = pipeline.predict(recs, ["k"], "moving_average", steps=2)
    assert rows.count() == 7 == summary.first()["total_records"] and ctx["time"] == "timestamp"
    with pytest.raises(ValueError):
        pipeline.detect(recs, "nope")
