import json
import os

from pyspark.sql import functions as F

from sifter.operators import reshape, validate
from sifter.plans import pipeline
from sifter.sources import routing, store


def test_run_dataset_from_catalog(spark, tmp_dir):  # K2, A13, A14
    src = os.path.join(tmp_dir, "orders.csv")
    with open(src, "w") as f:
        f.write("order_id,order_date,amount\n1,2026-01-01,5\n2,2026-01-02,7\n")
    catalog = {"local_orders": {"source_type": "local", "format": "csv", "path": src,
                                "source_name": None}}
    summary, meta = pipeline.run_dataset(spark, "local_orders", catalog, os.path.join(tmp_dir, "s"))
    assert summary.status == "SUCCESS" and summary.records_persisted == 2
    assert meta["source_name"] == "local_orders" and meta["source_location"] == src
    import pytest
    with pytest.raises(KeyError):
        pipeline.run_dataset(spark, "nope", catalog, os.path.join(tmp_dir, "s"))
    row = routing.catalog_frame(spark, catalog).first()
    assert (row["dataset_id"], row["source_name"], row["source_location"]) == ("local_orders", "local_orders", src)
    assert routing.register_catalog(spark, catalog | {"gone": {"path": src + ".no", "format": "csv"}}) == ["gone"]
    assert spark.table("local_orders").count() == 2


def test_flatten_with_metadata(spark):  # B11
    df = spark.createDataFrame([("a", "t", (1.0,), {"source": "crm"}), ("b", "t", (2.0,), {})],
                               "entity_id string, timestamp string, features struct<x:double>, "
                               "metadata map<string,string>")
    out = reshape.flatten_with_metadata(df).orderBy("entity_id").collect()
    assert out[0]["meta_source"] == "crm" and out[1]["meta_source"] is None
    assert list(out[0].asDict()) == ["entity_id", "timestamp", "x", "meta_source"]


def test_required_raw_fields(spark):  # C1
    ok = spark.createDataFrame([("2026", "s", "e")], "timestamp string, source string, event_type string")
    assert validate.has_required_fields(ok)
    assert not validate.has_required_fields(ok.drop("source"))
    m = spark.createDataFrame([({"timestamp": "t", "source": "s", "event_type": "e"},),
                               ({"timestamp": "t"},)], "record map<string,string>")
    assert [r[0] for r in m.select(validate.required_fields_present()).collect()] == [True, False]


def test_export_document(spark, tmp_dir):  # A23
    doc = spark.createDataFrame([(3, ["Sales", "Profit"])], "rows long, fields array<string>")
    path = os.path.join(tmp_dir, "export")
    store.export_document(doc, path)
    part = [f for f in os.listdir(path) if f.endswith(".json")][0]
    with open(os.path.join(path, part)) as f:
        assert json.loads(f.readline()) == {"rows": 3, "fields": ["Sales", "Profit"]}


def test_run_breakdown(spark):  # E29
    s = pipeline.RunSummary(records_ingested=3, records_valid=2, records_invalid=1,
                            records_persisted=2, runtime_seconds=0.5)
    metrics, breakdown = pipeline.run_breakdown(spark, s)
    assert metrics.first()["records_valid"] == 2
    assert {r["status"]: r["count"] for r in breakdown.collect()} == {"valid": 2, "invalid": 1}


def test_quick_start_flow(spark, tmp_dir):  # the README's quick start, on a local CSV
    from sifter.operators import anomaly, profile
    src = os.path.join(tmp_dir, "sales.csv")
    with open(src, "w") as f:
        f.write("order_id,order_date,sales,profit,category\n"
                "1,2026-01-01,10,2,A\n2,2026-01-02,12,3,B\n3,2026-01-03,11,1,A\n4,2026-01-04,90,5,B\n")
    out = os.path.join(tmp_dir, "store")
    assert pipeline.run_pipeline(spark, src, out, store_format="parquet").status == "SUCCESS"
    flat = reshape.flatten(store.load(spark, out, "parquet"))
    assert profile.overview(flat)["shape"].first()["rows"] == 4
    assert pipeline.chart_data(flat, "grouped-boxplot", compare="Category").count() == 2
    assert anomaly.severity(anomaly.iqr_detect(flat)).where("is_anomaly").count() >= 1
    rows, summary, ctx = pipeline.detect(pipeline.model_ready(spark, out, "parquet")[0], "zscore",
                                         threshold=1.5)
    assert summary.first()["total_records"] == 4 and ctx["value"] == "value"
