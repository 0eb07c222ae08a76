"""Sharding, mixing, archives, the pipeline and the SQL of the queries."""

import gzip
import hashlib
import io
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sifter.llm import mixing, oracle, queries, sharding, warc
from sifter.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(spark_df, con, sql):
    want = con.execute(sql).df()
    got = spark_df.toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v  # noqa: E731  pandas has longs with nulls as floats
    key = lambda f: sorted(str([plain(v) for v in r]) for r in f[cols].astype(object).where(f[cols].notna(), None).values.tolist())
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLE[name])


@pytest.mark.parametrize("limit", [40_000, 9_000])
def test_splitting_shards_equal_their_sql(spark, duck, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(sharding.shard(docs, limit, keep=["doc_id"]), duck, oracle.sharding_sql(limit))


def test_shards_of_repeated_ids_and_oversized_rows(spark, tmp_dir):
    rows = [(1, "x" * 100)] * 50 + [(None, "y" * 30), (2, None), (3, ""), (4, "z" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("own")).withColumn("h", F.lit(7))
    got = sharding.shard(df, 500)
    shards = got.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.max("shard_bytes").alias("s"), F.max("shard_rows").alias("r"),
                                      F.count("*").alias("n"), F.min("fits").alias("fits")).collect()
    assert got.count() == len(rows) and got.where("h = 7").count() == len(rows)
    assert all(x["b"] == x["s"] and x["n"] == x["r"] and x["fits"] == (x["b"] <= 500) for x in shards)
    assert [x["n"] for x in shards if not x["fits"]] == [1]
    assert sharding.shard(df.limit(0), 500).count() == 0
    sharding.write_shards(got, f"{tmp_dir}/shards")
    assert spark.read.parquet(f"{tmp_dir}/shards").count() == len(rows)


def test_poisson_counts_and_shuffle(spark):
    for rate in (0.0, 0.3, 1.0, 7.5, 80.0):
        us = [0.0, 0.1, 0.5, 0.9, 0.999999, 1 - 1e-9]
        got = spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson_count(F.lit(rate), F.col("u"))).collect()
        assert [r[0] for r in got] == [mixing.expected_count(rate, u) for u in us]
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("b").alias("source"),
                                     F.lit("abcd").alias("text"), F.lit("own").alias("_rate"), F.lit("own").alias("copy_no"))
    mixed = mixing.mix(docs, 3, weights={"hot": 3.0, "b": 1.0}, epochs=2.0)
    share = {r["source"]: r["n"] / mixed.count() for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert share["hot"] == pytest.approx(0.75, abs=0.02) and None not in share
    keys = [r["shuffle_key"] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys) and mixed.count() == pytest.approx(40000, rel=0.03)
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, source string, text string")
    assert {r["n_copies"] for r in mixing.mix(empty).collect()} <= set(range(20))


def test_arc_versions_convert_and_read_back(spark):
    records = [("http://a/%20b", "20200102030405", b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\nbody\r\n\r\nmore"), ("dns:x", "2020", b"\x00\xff\n\n")]
    for version in (1, 2):
        data = warc.arc_bytes("n.arc", version, records)
        back = list(warc.read_arc(data))
        assert [(r.fields["URL"], r.fields["Archive-date"], r.content) for r in back] == records
        assert set(back[0].fields) == set(warc.ARC_FIELDS[version])
        with pytest.raises(ValueError):
            list(warc.read_arc(data[:-6]))
    assert warc.warc_date("2020") == "2020-01-01T00:00:00Z" and warc.warc_date("20200102030405") == "2020-01-02T03:04:05Z"
    path = scratch_path(spark, "test-warc")
    archives = spark.createDataFrame([(bytearray(warc.arc_bytes("n.arc", v, records)),) for v in (1, 2)], "archive binary")
    warc.write_archives(warc.convert(archives).withColumn("refers_to", F.lit(None).cast("long")), path)
    got = {(r["uri"], r["record_type"], r["payload_digest"], r["page_id"]) for r in warc.read_archives(spark, path).collect()}
    assert got == {("http://a/%20b", "response", hashlib.sha1(b"body\r\n\r\nmore").hexdigest(), 4), ("dns:x", "resource", hashlib.sha1(b"\x00\xff\n\n").hexdigest(), None)}


def test_archived_pages_keep_payloads_and_mark_revisits(spark):
    big = "é\r\n\r\n" * 400
    rows = [(1, "http://a", big), (2, "http://b c", big), (9, None, big), (None, "http://n", big), (3, "http://s", "short"), (4, "http://t", "short"), (5, "x", None), (6, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("own"))
    path = scratch_path(spark, "test-pages")
    warc.archive_pages(pages, path, records_per_file=2)
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect()}
    want = {(p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", 9) if h == big and p != 9 else ("response", None))) for p, _, h in rows}
    assert got == want
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    assert all(len(list(warc.parse_warc(gzip.GzipFile(fileobj=io.BytesIO(f["content"]))))) <= 2 for f in files)
    empty = scratch_path(spark, "test-empty")
    warc.archive_pages(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_pipeline_stages_equal_brute_force_and_keep_the_columns(spark):
    from .test_pair_operators import classes
    from .test_text_operators import contaminated
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(rows)
    once = stages["jaccard_join"](spark, docs, SF)
    want, _ = classes(rows, corpus_pipeline.NEAR)
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in once.collect()) == sorted({c for _, _, c in want})
    clean = stages["decontamination"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _, hit, _, _ in contaminated(rows, items, 10) if not hit)
    mixed = stages["mixing"](spark, docs, SF)
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, **corpus_pipeline.MIX).collect()}
    u = {r["doc_id"]: (r["source"], r["u"]) for r in docs.select("doc_id", "source", mixing.uniform(corpus_pipeline.MIX_SEED, F.col("doc_id")).alias("u")).collect()}
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixed.columns == docs.columns
    assert counts == {d: n for d, (s, x) in u.items() if (n := mixing.expected_count(rate[s], x))}
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns[:len(docs.columns)] == docs.columns and whole.where("not fits").count() == 0 and whole.count() > 0


def test_pipeline_of_an_empty_table_and_of_odd_rows(spark, tmp_dir):
    """No row; and null ids, texts, sources and languages, repeated ids with one
    text and with others, a very long text, an extra column."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in given.where("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    odd = [(None, texts[0], "en", "s", 1), (None, texts[1], None, None, None), (5, texts[2], "en", "s", 1), (5, texts[3], "en", "s", 1), (5, texts[3], "en", "s", 1),
           (6, None, "en", "s", 0), (7, "", "en", None, 0), (8, " 12 ", "en", "s", 4), (9, " ".join(texts) * 3, "en", "t", 9)]
    for name, rows in (("none", []), ("odd", odd)):
        sf = f"{tmp_dir}/{name}"
        docs = spark.createDataFrame(rows, schema)
        if rows:
            docs = docs.unionByName(given.where("doc_id > 100").select(*docs.columns))
        docs.withColumn("_row", F.lit("own")).write.parquet(f"{sf}/documents.parquet")
        bench.write.parquet(f"{sf}/benchmark.parquet")
        stages, kept = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
        for stage in ("language_id", "jaccard_join", "decontamination", "mixing"):
            after = stages[stage](spark, kept, sf)
            assert after.columns == kept.columns
            if stage != "mixing":  # rows stay as they are
                assert after.exceptAll(kept).count() == 0
            if stage == "jaccard_join" and rows:
                ids = [r["doc_id"] for r in after.where("_row = 'own' and (doc_id is null or doc_id < 10)").collect()]
                assert ids.count(5) <= 2 and len([i for i in ids if i is None]) <= 2
            kept = after.transform(lambda df: spark.createDataFrame(df.collect(), df.schema))
        whole = corpus_pipeline.run(spark, sf)
        assert (whole.count() > 0) == bool(rows) and whole.where("not fits").count() == 0
