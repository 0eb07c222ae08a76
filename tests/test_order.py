import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sifter.functions.order import running_total, with_ordinal
from sifter.functions.quantile import column_quantiles, quantiles


def test_ordinal_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    out = with_ordinal(df, ["k"], num_partitions=7).collect()  # numeric key: key ranges
    assert sorted(r["record_index"] for r in out) == list(range(5000))
    assert all(r["record_index"] == r["k"] for r in out)
    txt = df.select(F.format_string("%05d", "k").alias("s"))
    out = with_ordinal(txt, ["s"], num_partitions=7).collect()  # text key: range partitions
    assert all(r["record_index"] == int(r["s"]) for r in out)


def test_ordinal_with_null_nan_and_infinite_keys(spark):
    key = (F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, float("nan"))
           .when(F.col("id") == 5, float("inf")).when(F.col("id") == 2, float("-inf"))
           .otherwise(F.col("id").cast("double")))
    df = spark.range(0, 3000).select("id", key.alias("k"))
    out = with_ordinal(df, ["k"], num_partitions=7).orderBy("record_index").collect()
    assert [r["record_index"] for r in out] == list(range(3000))
    assert all(r["k"] is None for r in out[:1000]) and all(np.isnan(r["k"]) for r in out[2000:])
    middle = [r["k"] for r in out[1000:2000]]
    assert middle == sorted(middle) and middle[0] == -np.inf and middle[-1] == np.inf
    odd = df.where("k is null or isnan(k)")  # no cuts at all
    assert sorted(r["record_index"] for r in with_ordinal(odd, ["k"], num_partitions=4).collect()) == list(range(2000))


def test_running_total_groups_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", "c"], [400, 3, 700]),
                        "k": np.arange(1103), "v": np.arange(1103) % 5})
    df = spark.createDataFrame(pdf)
    exp = pdf.groupby("g")["v"].cumsum() - pdf["v"]
    for method in ("partitions", "buckets"):
        out = running_total(df, ["k"], ["v"], ["g"], total_prefix="tot_", num_partitions=5,
                            method=method).toPandas().sort_values("k")
        assert (out["before_v"].to_numpy() == exp.to_numpy()).all(), method
        assert (out.groupby("g")["tot_v"].first() == pdf.groupby("g")["v"].sum()).all()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), [np.nan] * 10])
    grp = np.where(np.arange(len(vals)) % 3 == 0, "x", "y")
    df = spark.createDataFrame(pd.DataFrame({"g": grp, "v": vals}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, "v", probs, ["g"]).toPandas().set_index("g")
    for g in ("x", "y"):
        x = vals[(grp == g) & ~np.isnan(vals)]
        for i, p in enumerate(probs):
            assert abs(got.loc[g, f"q_{str(p).replace('.', '_')}"] - np.quantile(x, p)) < 1e-12
        assert got.loc[g, "n"] == len(x)


def test_quantiles_single_value_and_approx(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    r = quantiles(df, "v", [0.25, 0.75]).first()
    assert r["q_0_25"] == 5.0 and r["q_0_75"] == 5.0 and r["n"] == 1
    a = quantiles(spark.range(1001).select(F.col("id").cast("double").alias("v")), "v", [0.5],
                  accuracy="approx").first()
    assert abs(a["q_0_5"] - 500) <= 1


def test_quantiles_of_ties_few_values_and_wide_columns(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 4000).astype(str), "two": np.repeat([1.0, 2.0], 2000),
                        "v": np.round(rng.exponential(size=4000), 2), "none": np.full(4000, np.nan),
                        "hot": np.where(np.arange(4000) % 3 == 0, 7.0, rng.normal(size=4000))})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = column_quantiles(df, {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in ("two", "v", "none", "hot")}, probs)
    assert set(got) == {"two", "v", "hot"}
    for c, (n, q) in got.items():
        assert n == 4000 and np.allclose(q, np.quantile(pdf[c], probs), atol=1e-12)
    for c in ("two", "v", "hot"):
        by = quantiles(df, c, probs, ["g"]).toPandas().set_index("g")
        for g, part in pdf.groupby("g"):
            assert np.allclose(by.loc[g].to_numpy()[1:], np.quantile(part[c], probs), atol=1e-12)


def test_release_unpersists(spark):
    from sifter.functions.cache import release
    release()
    # a text key takes the range-partition path, which persists its input
    df = with_ordinal(spark.range(100).select(F.format_string("%03d", "id").alias("k")), ["k"])
    assert df.count() == 100
    assert release() == 1
    assert df.count() == 100  # still computable from lineage after release


def test_running_total_buckets_ungrouped_with_ties_in_values(spark):
    pdf = pd.DataFrame({"s": np.round(np.linspace(0, 1, 3001), 3), "c": np.arange(3001) % 7})
    df = spark.createDataFrame(pdf)
    out = running_total(df, ["s"], ["c"], num_partitions=16).toPandas().sort_values("s")
    assert (out["before_c"].to_numpy() == (pdf["c"].cumsum() - pdf["c"]).to_numpy()).all()
