"""Top-k search and the Jaccard join against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sifter.llm import decontaminate, jaccard, topk, words
from sifter.llm.components import components


def best(rows, every, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = np.floor(np.array(v, float) * 256).astype(np.int64)
        good[i] = min(good.get(i, tuple(q)), tuple(q))
    out = []
    for i in sorted(good):
        if i % every == 0:
            scored = sorted((-int(np.dot(good[i], good[j])), j) for j in good if j != i and len(good[j]) == len(good[i]))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def test_top_k_equals_brute_force_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (centres[i % 6] + rng.normal(size=8) * 0.1)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 600)]  # one very common vector
    rows += [(600, None), (None, [0.1] * 8), (601, [float("nan")] * 8), (602, [None] + [0.1] * 7), (605, [float("inf")] * 8),
             (700, [1.0, 2.0]), (701, [1.0, 3.0]), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("own")).repartition(4)
    for kw in ({}, {"shard_rows": 50, "block_rows": 3, "leaf": 4, "first_wave": 3}):
        got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, **kw)
        assert sorted(map(tuple, got.collect())) == best(rows, 10, 5)


def test_top_k_of_large_components_is_exact_and_an_empty_table_has_no_rows(spark):
    rows = [(i, [float(2**20 + i), float(-(2**21) + 3 * i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect())) == best(rows, 10, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_up_to_the_ends_of_the_longs(spark):
    """No vector is left out for its size: sums beyond 2**64 that cancel, scores
    that only just fit, and scores that don't."""
    big = 2.0**40
    rows = [(0, [1.0, 0.0]), (1, [2.0**24, 0.0]), (2, [2.0, 0.0]), (3, [big, big]), (4, [big, -big]), (5, [big, 1 - big]), (6, [-big, 3.0]), (10, [2.0**54, 2.0**54]),
            (7, [2.0**60, 0.0]), (20, [-(2.0**54), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(x * 256)) for x in v] for i, v in rows if i != 7}  # its integer is no long
    want = []
    for q in ints:
        if q % 5 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(ints[q], ints[j])), -(2**63) + 1), 2**63 - 1), j) for j in ints if j != q)
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]
    for kw in ({}, {"shard_rows": 3, "leaf": 1}):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, **kw).collect())) == sorted(want)


def classes(rows, rule):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k:k + rule.words]) for k in range(len(w) - rule.words + 1)} if len(w) >= rule.words else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if rule.den * common >= rule.num * (len(sets[a]) + len(sets[b]) - common):
                p, q = find(rows[a][0]), find(rows[b][0])
                root[max(p, q)] = min(p, q)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=key), key


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10**6) * 1000 + i, " ".join(t)))
            i += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))  # common to many unrelated texts
    rows += [(j, " ".join(rng.choice(vocabulary) for _ in range(60)) + " " + passage) for j in range(100)]
    return rows + [(501, None), (502, " "), (None, rows[0][1]), (rows[3][0], rows[130][1])]


@pytest.mark.parametrize("rule, kw", [
    (jaccard.Rule(), {}), (jaccard.Rule(), {"region_shingles": 1000, "levels": 1}),
    (jaccard.Rule(2, 50, 100), {"region_shingles": 3000}), (jaccard.Rule(2, 50, 100), {"region_shingles": 2000, "thin_points": 3}), (jaccard.Rule(2, 50, 100), {"region_shingles": 1500, "levels": 0})])
def test_jaccard_join_equals_brute_force(spark, texts, rule, kw):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(5)
    want, key = classes(texts, rule)
    assert sorted(map(tuple, jaccard.near_duplicates(df, rule, **kw).collect()), key=key) == want


def test_one_of_each_group_stays(spark, texts):
    """Rows equal in id and text are one, others stand for themselves."""
    rows = texts + [(None, texts[0][1]), (None, "no copy of anything else"), (None, None), (None, None), (501, None), (501, "shares an id only"),
                    texts[5], texts[5], (77, "w " * 40_000 + "end of a very long text"), (78, "w " * 40_000 + "end of a very long text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("own")).withColumn("key", F.lit(1))
    rule = jaccard.Rule(5, 80, 100)
    unique = sorted(set(rows), key=str)
    groups, _ = classes([(i, t) for i, (_, t) in enumerate(unique)], rule)
    want = [r for r in rows if not (r[1] or "").strip()]
    for c in {c for i, n, c in groups if n}:
        members = [unique[i] for i, n, k in groups if k == c and n]
        want.append(min(members, key=lambda r: (r[0] is None, r[0] or 0, str(r[1]))))
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_per_group(df, rule).collect()]
    assert sorted((str(d) for d, _ in kept)) == sorted(str(d) for d, _ in want) and len(kept) == len(want)
    assert jaccard.one_per_group(df.limit(0), rule).columns == df.columns
    assert jaccard.near_duplicates(df.limit(0)).count() == 0 == jaccard.one_per_group(df.limit(0), rule).count()


def python_steps_at_once(plan):
    """The most Python steps that a task of the plan runs at the same time."""
    chain, most = [(-1, 0)], 0
    for line in plan.splitlines():
        step = re.search("[A-Z].*", line)
        if step:
            depth = line.index("+- ") if "+- " in line else line.index(":- ") if ":- " in line else 0
            while chain[-1][0] >= depth:
                chain.pop()
            name = step.group().split(" ")[0]
            n = (0 if name.endswith("Exchange") else chain[-1][1]) + name.startswith(("ArrowEvalPython", "MapInArrow", "FlatMapGroupsInArrow"))
            chain.append((depth, n))
            most = max(most, n)
    return most


def test_a_task_has_one_python_worker(spark, texts, monkeypatch):
    """A function that Spark evaluates twice in a stage needs a second worker in
    each task, which keeps its memory from then on."""
    plans = {}

    def written(df, tag, write=jaccard.written):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(jaccard, "written", written)
    jaccard.one_per_group(spark.createDataFrame(texts, "doc_id long, text string"), jaccard.Rule(5, 80, 100))
    assert {tag: python_steps_at_once(p) for tag, p in plans.items() if python_steps_at_once(p) > 1} == {}
    assert python_steps_at_once(plans["points"]) == python_steps_at_once(plans["regions"]) == 1


def test_hashing_texts_takes_little_memory(spark):
    rng = np.random.default_rng(2)
    col = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 10**6, 500)) for _ in range(1000)])
    search = decontaminate._search(type("Shared", (), {"value": decontaminate.TestSuffixes([("a", col[3].as_py())], 10)})).func
    whole = jaccard.shingles(col, 5)[0]
    words._tables.cache_clear()
    for work in (lambda: sum(map(len, jaccard.shingle_sets(col, 5))), lambda: search(col)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12e6
    assert set(np.concatenate(list(jaccard.shingle_sets(col, 5))).tolist()) == set(whole.tolist())  # cut anywhere, the same shingles


def test_a_filter_holds_its_numbers_and_few_others(spark):
    for n in (0, 1, 20_000):
        f = jaccard._filter(spark.range(n).selectExpr("id * 7 as x"))
        own = np.arange(n, dtype=np.int64) * 7
        assert f.holds(own).all() and f.holds(own + 3).sum() <= 0.1 * n + 1


def test_different_orders_of_the_same_words_are_different_shingles():
    import itertools

    import pyarrow as pa
    every = [" ".join(p) for p in set(itertools.product("ab", repeat=4))]
    assert len(set(np.concatenate(list(jaccard.shingle_sets(pa.array(every), 4))).tolist())) == 16


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {k: v for k, v in got.items() if k != v} == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
