"""The Merkle manifest against a plain tree, and its address arithmetic."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifter.llm import langid, merkle

FIELDS = ["doc_id", "source", "text"]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row, fields=FIELDS):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in fields))


def plain_tree(digests):
    """Levels of a tree of 16."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_steps(levels, at):
    for level in levels[:-1]:
        run = at // 16 * 16
        yield level[run:at], level[at + 1:run + 16]
        at //= 16


def plain(rows, tampered):
    """Rows (dicts) in table order -> list of expected results."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        trees[s] = plain_tree([plain_leaf(r) for r in groups[s]])
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = [*plain_steps(trees[s], i), *plain_steps(top, k)]
            fold = plain_leaf(tampered(r))
            for before, after in steps:
                fold = sha("".join([*before, fold, *after]))
            proof = "".join("".join(b + a) for b, a in steps)
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], sha(proof), fold))
    return out


def lowered(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {**r, "text": r["text"].translate(low)} if hit and r["text"] is not None else r


def run(df, **kw):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    m = merkle.build(df, FIELDS, group_col="source", order_col="doc_id",
                     changed={"text": F.when(langid.fold("doc_id", 5) == 0, low).otherwise(F.col("text"))})
    return m, merkle.proofs(m, **kw)


def results(found):
    return [tuple(r) for r in found.select("id", "digest", "subroot", "root", "proof_sha256", "folded").collect()]


def check(spark, rows):
    """Repeated ids keep table order only as one file does, hence one partition."""
    df = spark.createDataFrame([(r["doc_id"], r["source"], r["text"], 1, "x") for r in rows],
                               "doc_id long, source string, text string, pos int, digest string").coalesce(1)
    m, found = run(df)
    assert sorted(results(found), key=str) == sorted(plain(rows, lowered), key=str)
    return m


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("height", [1, 2, 3, 4, 5])
def test_addresses_are_a_layout_that_keeps_halves_together(bits, height):
    if bits * height > 16:
        return
    levels = [np.arange(1 << bits * d) for d in range(height)]
    every = [merkle.address(height, d, i, bits) for d, i in enumerate(levels)]
    assert sorted(np.concatenate(every)) == list(range(merkle.tree_size(height, bits)))
    if height > 1:  # the top half comes first, then each bottom half in one piece
        top, low = height // 2, height - height // 2
        assert max(e.max() for e in every[:top]) == merkle.tree_size(top, bits) - 1
        for root in range(1 << bits * top):
            own = np.concatenate([every[top + d][root << bits * d:(root + 1) << bits * d] for d in range(low)])
            assert own.max() - own.min() + 1 == len(own) == merkle.tree_size(low, bits)


def test_nulls_empty_texts_ties_and_clashing_names(spark):
    rows = [{"doc_id": i % 40, "source": "s" if i % 3 else "Ä", "text": f"Text {i} ABC"} for i in range(100)]
    rows += [{"doc_id": None, "source": None, "text": None}, {"doc_id": None, "source": "s", "text": ""},
             {"doc_id": 7, "source": None, "text": "X" * 100_000}, {"doc_id": 500, "source": "lone", "text": "One"}]
    check(spark, rows)


def test_one_row_and_no_row(spark):
    m = check(spark, [{"doc_id": 5, "source": "a", "text": "Q"}])
    assert m.blocks().count() == 2
    m, found = run(spark.createDataFrame([], "doc_id long, source string, text string"))
    assert m.root is None and found.count() == 0


@pytest.mark.parametrize("n", [16, 17, 257, 4096, 4097, 9000])
def test_a_group_larger_than_a_block(spark, n):
    rows = [{"doc_id": i, "source": "hot", "text": f"Row {i}"} for i in range(n)] + [{"doc_id": i, "source": "b", "text": None} for i in range(3)]
    m = check(spark, rows)
    assert len(m.tiers) == (1 if n <= 4096 else 2)
    places = sorted((r["place"], r["tier"]) for r in m.blocks().where("tree = 'group' and g = 'hot'").collect())
    assert [p for p, _ in places] == list(range(len(places))) and places[0][1] == len(m.tiers) - 1


def test_siblings_lead_to_the_root_and_a_changed_row_does_not(spark):
    rows = [{"doc_id": i, "source": f"s{i % 20}", "text": f"Row {i}"} for i in range(700)]
    df = spark.createDataFrame([(r["doc_id"], r["source"], r["text"]) for r in rows], "doc_id long, source string, text string")
    _, found = run(df, siblings=True)
    for r in found.collect():
        assert sha("".join(r["siblings"])) == r["proof_sha256"]
        assert (r["folded"] == r["root"]) == (zlib.crc32(str(r["id"]).encode()) % 5 != 0)
