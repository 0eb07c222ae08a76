from pyspark.sql import functions as F

from sifter.operators.forest import IsolationForestModel, c_factor
from sifter.operators.kmeans import KMeansModel


def _records(spark, values):
    return spark.createDataFrame([(str(i), f"t{i}", v) for i, v in enumerate(values)],
                                 "entity_id string, timestamp string, value double")


def test_kmeans_fixture_optimum(spark):  # FX21
    recs = _records(spark, [10.0, 11.0, 12.0, 13.0, 80.0])
    m = KMeansModel(n_clusters=3).fit(recs)
    assert m.centres == [10.5, 12.5, 80.0]
    assert abs(m.threshold - 0.8) < 1e-12
    out = m.transform(recs).collect()
    assert [r["anomaly_score"] for r in out] == [0.5, 0.5, 0.5, 0.5, 0.0]
    assert not any(r["is_anomaly"] for r in out)


def test_kmeans_small_and_missing(spark):
    recs = _records(spark, [None, 4.0])
    m = KMeansModel(n_clusters=3).fit(recs)
    assert sorted(m.centres) == [0.0, 4.0]
    assert m.transform(recs).count() == 2
    empty = _records(spark, [1.0]).limit(0)
    assert KMeansModel().fit(empty).transform(empty).count() == 0


def test_isolation_forest_invariants(spark):  # FX23
    recs = _records(spark, [100.0, float("nan"), 105.0, float("nan"), 110.0, 500.0])
    out = IsolationForestModel().fit(recs).transform(recs).orderBy("entity_id").collect()
    scores = [r["anomaly_score"] for r in out]
    assert all(s is not None for s in scores)
    assert min(range(6), key=lambda i: scores[i]) == 5
    assert out[5]["is_anomaly"]


def test_isolation_forest_rate_and_determinism(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("entity_id"),
                                  F.lit("t").alias("timestamp"),
                                  (F.sin(F.col("id")) * 10 + F.when(F.col("id") % 97 == 0, 60)
                                   .otherwise(0)).alias("value"))
    a = IsolationForestModel(seed=7).fit(df).transform(df)
    rate = a.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert 0.08 <= rate <= 0.1
    top = a.orderBy("anomaly_score").limit(5).collect()
    assert all(r["value"] > 40 for r in top)
    b = IsolationForestModel(seed=7).fit(df).transform(df)
    assert a.select("entity_id", "anomaly_score").exceptAll(
        b.select("entity_id", "anomaly_score")).count() == 0


def test_c_factor():
    assert c_factor(1) == 0.0 and c_factor(2) == 1.0
    assert abs(c_factor(256) - 10.244770920116851) < 1e-9


def test_isolation_forest_does_not_depend_on_partitions(spark):
    from sifter.operators.forest import IsolationForestModel
    rows = spark.range(3000).select(F.col("id").cast("string").alias("entity_id"), F.lit("t").alias("timestamp"),
                                    F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("value"))
    flags = []
    for n in (2, 7):  # more rows than candidates: 4 * 5 * 16
        df = rows.repartition(n)
        m = IsolationForestModel(n_trees=5, max_samples=16).fit(df)
        flags.append({r["entity_id"] for r in m.transform(df).where("is_anomaly").collect()})
    assert flags[0] == flags[1] and flags[0]
