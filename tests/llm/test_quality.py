"""The quality classifier: vectors, features and scores against plain loops, and
accuracy on held-out labels."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sifter.llm import langid, quality, queries
from sifter.llm.words import WHITE_SPACE, hashed_words

SF = "/root/testdata/sf0.01"
SETTINGS = quality.Settings(sample_rows=400, label_rows=100, epochs=5)


def words(text):
    return (text or "").replace("\t", " ").replace("\n", " ").split(" ")


def classes(text):
    every = [w for w in words(text) if w]
    return [int(quality._classes(hashed_words(pa.array([w]), WHITE_SPACE)[0])[0]) for w in every]


def plain_contexts(texts, settings):
    where, sign = quality.index_vectors(settings)
    out = np.zeros((quality.CLASSES, quality.WIDTH), np.int64)
    for t in texts:
        c = classes(t)
        for i, a in enumerate(c):
            for j in range(max(0, i - settings.window), min(len(c), i + settings.window + 1)):
                if j != i:
                    for k in range(settings.nonzero):
                        out[a, where[c[j], k]] += sign[c[j], k]
    return out


def plain_score(text, model):
    v = [model.vectors[c] / quality.GRAIN for c in classes(text)]
    if v:
        mean = [math.fsum(x[d] for x in v) / len(v) for d in range(quality.WIDTH)]
        spread = [math.sqrt(max(math.fsum(x[d] ** 2 for x in v) / len(v) - mean[d] ** 2, 0)) for d in range(quality.WIDTH)]
        like = math.fsum(float(a @ b) for a, b in zip(v, v[1:])) / max(len(v) - 1, 1)
        x = [*mean, *spread, like, math.log(1 + len(v)), 1.0]
    else:
        x = [0.0] * quality.N_FEATURES
    net = model.network
    hidden = [math.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * net.first[i, h] for i in range(len(x))) + net.first_bias[h]) for h in range(len(net.second))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(hidden, net.second)) + net.second_bias) / net.temperature))


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, _quality double, h string")


def labels(spark, rows):
    return spark.createDataFrame([(d, y, "x") for d, y in rows], "doc_id long, quality int, text string")


TEXTS = ["a good line of words", "JUNK!! JUNK!! junk!!", None, "", " \n\t", "one", "é è é", "long " * 70_000 + "end", "a b\ta\nb a", "a good line of words"] * 3


def test_contexts_features_and_scores_equal_plain_loops(spark):
    df = table(spark, TEXTS).repartition(5)
    short = [t for t in TEXTS if t is None or len(t) < 1000]
    got = quality.context_vectors(table(spark, short).repartition(4), SETTINGS)
    assert (got == plain_contexts(short, SETTINGS)).all()
    model = quality.learn(df, labels(spark, [(i, i % 2) for i in range(len(TEXTS))]), F.lit(True), SETTINGS)
    found = {r["doc_id"]: r["_quality"] for r in quality.score(df, model).collect()}
    assert len(found) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert found[i] == pytest.approx(plain_score(t, model), abs=1e-5)
    assert len({found[i] for i, t in enumerate(TEXTS) if not (t or "").strip()}) == 1  # null, empty and blank texts


def test_the_model_does_not_depend_on_partitions_and_equal_rows_count_once(spark):
    docs, marks = table(spark, TEXTS[:9]), labels(spark, [(i, i % 2) for i in range(9)])
    one = quality.learn(docs.coalesce(1), marks, F.lit(True), SETTINGS)
    more = quality.learn(docs.repartition(7), marks.union(marks).repartition(3), F.lit(True), SETTINGS)
    assert (one.vectors == more.vectors).all() and (one.network.first == more.network.first).all()
    twice = quality.learn(docs, marks, F.lit(True), SETTINGS)
    assert (one.network.second == twice.network.second).all()


def test_few_or_no_labels_and_empty_tables(spark):
    docs, none = table(spark, TEXTS[:9]), labels(spark, [])
    for marks, want in ((none, 0.5), (labels(spark, [(None, 1), (1, None), (2, 7)]), 0.5), (labels(spark, [(0, 1)]), 2 / 3)):
        model = quality.learn(docs, marks, F.lit(True), SETTINGS)
        assert {round(r["_quality"], 9) for r in quality.score(docs, model).collect()} == {round(want, 9)}
    empty = docs.limit(0)
    model = quality.learn(empty, none, F.lit(True), SETTINGS)
    assert quality.score(empty, model).count() == 0 and quality.score(docs, model).columns == docs.columns


def test_held_out_accuracy_and_no_use_of_held_out_labels(spark):
    got = queries.op12_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and ((held.score >= 0.3) == (held.predicted == 1)).all() and held.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() >= 0.95
    assert (held[held.quality == 1].score.mean() - held[held.quality == 0].score.mean()) > 0.6
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    use = langid.fold("doc_id", 5) != 0
    flipped = marks.withColumn("quality", F.when(use, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.learn(docs, m, use, SETTINGS).network for m in (marks, flipped))
    assert (a.first == b.first).all() and a.temperature == b.temperature
