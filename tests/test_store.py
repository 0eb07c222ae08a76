"""The versioned store, stored detectors, exact samples and the overview document."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sifter.operators import anomaly, detectors, profile, reshape
from sifter.operators.forest import IsolationForestModel, c_factor
from sifter.operators.kmeans import KMeansModel
from sifter.plans import pipeline
from sifter.sources import routing, store


def _records(spark, n, first=0):
    rows = spark.range(first, first + n).select(F.concat(F.lit("e"), "id").alias("cust_id"), F.lit("2026-01-01T00:00:00").alias("event_time"), (F.col("id") * 1.5).alias("amount"))
    return reshape.adapt(rows)


def _entities(df):
    return sorted(r["entity_id"] for r in df.select("entity_id").collect())


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_failed_save_leaves_the_old_records(spark, tmp_dir, fmt):  # A15, A17
    path = os.path.join(tmp_dir, "s")
    store.save(_records(spark, 3), path, fmt)
    broken = _records(spark, 5).withColumn("entity_id", F.when(F.col("entity_id") == "e4", F.raise_error(F.lit("died"))).otherwise(F.col("entity_id")))
    with pytest.raises(Exception, match="died"):
        store.save(broken, path, fmt)
    assert _entities(store.load(spark, path, fmt)) == ["e0", "e1", "e2"]


def test_a_store_is_overwritten_from_a_frame_that_reads_it(spark, tmp_dir):
    path = os.path.join(tmp_dir, "s")
    store.save(_records(spark, 4), path, "parquet")
    old = store.load(spark, path, "parquet")
    entry = store.save(old.where("entity_id <> 'e0'").unionByName(_records(spark, 1, 9)), path, "parquet")
    assert entry["record_count"] == 4 and _entities(store.load(spark, path, "parquet")) == ["e1", "e2", "e3", "e9"]
    assert old.count() == 4  # a reader that has begun
    assert store.stored_metadata(spark, path).first()["record_count"] == 4
    for i in range(3):
        store.save(_records(spark, 1, i), path, "json")
    assert sum(n.startswith("v-") for n in os.listdir(path)) == store.KEPT_VERSIONS
    assert _entities(store.load(spark, path, "parquet")) == ["e2"]  # the manifest knows the format
    store.reset(spark, path)
    assert store.load(spark, path).count() == 0 and store.stored_metadata(spark, path).first()["record_count"] == 0
    assert store.stored_metadata(spark, path + "-none").count() == 0


def test_two_saves_cannot_take_one_number(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "s")
    store.save(_records(spark, 1), path)
    found = store._manifests(spark, path)
    monkeypatch.setattr(store, "_manifests", lambda *a, **k: [{**found[0], "number": 0}])
    with pytest.raises(Exception, match="exist"):
        store.save(_records(spark, 2), path)


def test_plain_folders_are_read_and_replaced(spark, tmp_dir):
    path = os.path.join(tmp_dir, "plain")
    _records(spark, 2).write.parquet(path)
    assert store.load(spark, path, "parquet").count() == 2
    store.save(_records(spark, 3), path, "parquet")
    assert store.load(spark, path, "parquet").count() == 3 and not [f for f in os.listdir(path) if f.endswith(".parquet")]


def test_lookup_layout_skips_row_groups(spark, tmp_dir):  # C7
    path = os.path.join(tmp_dir, "s")
    store.save(_records(spark, 20_000).repartition(8), path, "parquet", lookup=True)
    found = store.load(spark, path, "parquet").where("entity_id = 'e777'")
    assert found.count() == 1
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().apply("numOutputRows").value() < 20_000


def test_history_that_cannot_be_read_raises(spark, tmp_dir):  # A22
    path = os.path.join(tmp_dir, "runs")
    assert store.last_run_summary(spark, path).first()["status"] == "no runs recorded"
    os.makedirs(path)
    assert store.last_run_summary(spark, path).first()["status"] == "no runs recorded"
    with open(os.path.join(path, "x.json"), "wb") as f:
        f.write(b"{not json\n")
    with pytest.raises(Exception):
        store.last_run_summary(spark, path).collect()


def test_pipeline_scans_its_source_once_and_routes(spark, tmp_dir, monkeypatch):  # K1, A12
    src = os.path.join(tmp_dir, "src")
    _records(spark, 50).select(F.col("entity_id").alias("cust_id"), F.col("timestamp").alias("event_time"), "features.amount").coalesce(2).write.parquet(src)
    reads = spark.sparkContext.accumulator(0)

    def load(spark_, path, fmt=None, **kw):
        def count(batches):
            for b in batches:
                reads.add(b.num_rows)
                yield b
        df = spark_.read.parquet(path)
        return df.mapInArrow(count, df.schema)
    monkeypatch.setattr(pipeline.readers, "load", load)
    monkeypatch.setattr(pipeline.readers, "normalize_loaded", lambda df: df)
    s = pipeline.run_pipeline(spark, src, os.path.join(tmp_dir, "s"), "parquet", "parquet", mode="local")
    assert s.status == "SUCCESS" and (s.records_ingested, s.records_persisted) == (50, 50)
    assert reads.value == 50 and s.intelligence["total_records"] == 50
    s = pipeline.run_pipeline(spark, None, os.path.join(tmp_dir, "s"), mode="cloud", config=routing.StoreConfig())
    assert s.status == "FAILED" and s.failed_stage == "ingestion" and "account" in s.error_message
    assert store.load(spark, os.path.join(tmp_dir, "s"), "parquet").count() == 50


# ---------------------------------------------------------------- J6, J10

def _values(spark, values):
    return spark.createDataFrame([(str(i), "t", v) for i, v in enumerate(values)], "entity_id string, timestamp string, value double")


@pytest.mark.parametrize("values", [[5.0] * 5000, [1.0], [None, 2.0, 2.0], [7.0, 8.0], [float("inf"), 1.0, 2.0, float("-inf")], [1.7e308, -1.7e308, 0.0]])
def test_forest_of_few_values(spark, values):
    df = _values(spark, values)
    out = IsolationForestModel(n_trees=20).fit(df).transform(df)
    assert out.count() == len(values)
    present = {v for v in values if v is not None}
    if len(present) == 1 and None not in values:  # every score is the offset
        assert out.where("is_anomaly").count() == 0


def test_forest_samples_are_exact_and_hold_copies_in_proportion(spark):
    values = [0.0] * 3000 + [float(i) for i in range(1, 6001)]
    m = IsolationForestModel(n_trees=40, max_samples=128)
    picked = []
    for parts in (1, 7):
        df = _values(spark, values).repartition(parts).select(F.col("value").alias("x"))
        picked.append(sorted(map(tuple, m.sample(df, len(values), 128).collect())))
    assert picked[0] == picked[1] and len(picked[0]) == 40 * 128
    share = sum(x == 0.0 for _, x in picked[0]) / len(picked[0])
    assert 0.28 < share < 0.39
    for t in range(40):  # without replacement
        own = [x for k, x in picked[0] if k == t and x != 0.0]
        assert len(own) == len(set(own))
    everything = IsolationForestModel(n_trees=3).sample(_values(spark, [1.0, 2.0, 2.0]).select(F.col("value").alias("x")), 3, 3)
    assert sorted(map(tuple, everything.collect())) == [(t, x) for t in range(3) for x in (1.0, 2.0, 2.0)]


def test_forest_of_a_million_equal_rows_and_one_other(spark):
    df = spark.range(1_000_001).select(F.lit("e").alias("entity_id"), F.lit("t").alias("timestamp"), F.when(F.col("id") == 77, 900.0).otherwise(5.0).alias("value"))
    out = IsolationForestModel(n_trees=10).fit(df).transform(df)
    assert out.where("is_anomaly and value < 900").count() == 0


def test_forest_scores_equal_their_own_leaves(spark):
    """One value in every tree's own leaf or not: path lengths by hand."""
    df = _values(spark, [1.0, 2.0])
    m = IsolationForestModel(n_trees=4).fit(df)
    assert [round(x, 9) for x in m.scores] == [round(-2 ** (-1 / c_factor(2)), 9)] * len(m.scores)


@pytest.mark.parametrize("model", [anomaly.ThresholdModel(3.0), anomaly.ZScoreModel(1.0), anomaly.IQRModel(["value"]), KMeansModel(n_clusters=2), IsolationForestModel(n_trees=10)])
def test_stored_detectors_score_another_table(spark, tmp_dir, model):
    train, other = _values(spark, [1.0, 2.0, 3.0, 4.0, 50.0]), _values(spark, [2.5, None, 60.0, -40.0])
    model.fit(train)
    detectors.save(spark, model, tmp_dir + "/m")
    again = detectors.load(spark, tmp_dir + "/m")
    assert type(again) is type(model) and again.state() == model.state()
    assert sorted(map(str, again.transform(other).collect())) == sorted(map(str, model.transform(other).collect()))
    stream = spark.readStream.schema(other.schema).parquet(tmp_dir + "/m")  # a plan suffices
    assert again.transform(stream).isStreaming


def test_an_unfitted_detector_is_not_stored(spark, tmp_dir):
    with pytest.raises(ValueError):
        detectors.to_frame(spark, KMeansModel())


# ---------------------------------------------------------------- E8, A23

def test_overview_document(spark, tmp_dir):
    df = spark.createDataFrame([("1", "2026-01-02", 10.0, "A", None), ("2", "2026-01-01", None, "B", 4), ("3", "x", 30.0005, "A", 5), ("4", None, float("nan"), None, 6)],
                               "entity_id string, timestamp string, sales double, category string, quantity int")
    doc = profile.overview_document(df, routing.dataset_metadata(spark, "d", {"source_type": "csv", "path": "p.csv"}))
    row = doc.first().asDict(recursive=True)
    assert (row["rows"], row["columns"], row["fields"], row["compare_options"]) == (4, 5, ["Sales", "Quantity", "Category", "Order Date"], ["Quantity", "Category", "Order Date"])
    numeric = {r.pop("field"): r for r in row["numeric"]}
    assert numeric["Sales"] == {"count": 2, "missing": 2, "min": 10.0, "max": 30.0005, "mean": 20.0003, "median": 20.0003, "std": 14.1425}
    assert numeric["Quantity"]["median"] == 5.0
    assert row["dates"] == [{"field": "Order Date", "count": 2, "missing": 2, "min_date": "2026-01-01", "max_date": "2026-01-02"}]
    assert row["categories"] == [{"field": "Category", "count": 3, "missing": 1, "unique": 2, "top": [{"value": "A", "count": 2}, {"value": "B", "count": 1}]}]
    assert row["charts"]["time-line"] == {"target_variable": "Sales", "compare_variable": "Order Date"} and row["source"]["source_name"] == "d"
    store.export_document(doc, tmp_dir + "/doc")
    part = next(f for f in os.listdir(tmp_dir + "/doc") if f.endswith(".json"))
    with open(f"{tmp_dir}/doc/{part}") as f:
        assert json.loads(f.readline())["rows"] == 4
    empty = profile.overview_document(df.limit(0)).first()
    assert empty["rows"] == 0 and empty["categories"][0]["top"] == []


def test_heavy_values_are_exact_whatever_the_sketch_holds(spark):  # G1
    rows = spark.range(30_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 17 = 0 then null else concat('v', pmod(xxhash64(id), 4000)) end as v", "id")
    want = [tuple(r) for r in rows.where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(5).collect()]
    for tracked in ((16,), (16, 8192), (8192,), ()):
        assert [tuple(r) for r in profile.heavy_values(rows, "v", 5, tracked).collect()] == want
    assert profile.heavy_values(rows.limit(0), "v").count() == 0
    few = spark.createDataFrame([(1.0,), (1.0,), (float("nan"),), (None,), (2.0,)], "v double")
    assert [tuple(r) for r in profile.heavy_values(few, "v").collect()] == [(1.0, 2), (2.0, 1)]


def test_standard_cleaning_audit_equals_the_two_sided_one(spark):  # E22
    rows = [("1", "2026-01-01", 1.0, "a", 0), ("1", "2026-01-01", None, "b", 1), ("1", "2026-01-01", 3.0, None, 2), (None, "2026-01-01", 4.0, "c", 3),
            ("2", None, None, None, 4), ("2", None, 1.0, None, 5), ("", "2026-01-02", 1.0, None, 6), ("3", "2026-01-03", float("nan"), None, 7)]
    df = spark.createDataFrame(rows, "id string, order_date string, sales double, kind string, k int")
    canon = reshape.adapt(df, keep=["k"])
    from sifter.operators import validate
    valid, _ = validate.split_valid(canon)
    copies = validate.duplicates(valid.withColumnRenamed("k", "record_index"))
    after = valid.join(copies.select(F.col("record_index").alias("k")), "k", "left_anti")
    want = pipeline.cleaning_audit(canon.drop("k"), after.drop("k")).collect()
    assert pipeline.standard_cleaning_audit(canon, "k").collect() == want


def test_missed_brackets_grow_until_they_hold(spark, monkeypatch):
    from sifter.functions import quantile
    right = quantile._cells
    monkeypatch.setattr(quantile, "_cells", lambda share, slack=1: right(share, slack) if slack > 1 else (0, 1))
    df = spark.range(5001).select(F.col("id").cast("double").alias("v"))
    assert quantile.column_quantiles(df, {"v": F.col("v")}, [0.5, 0.9])["v"] == (5001, [2500.0, 4500.0])
