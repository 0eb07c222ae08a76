"""Spelling variants against brute force: words, near pairs, forms and roots."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sifter.llm import spelling
from sifter.llm.spelling import Rule

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, rule):
    n = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if rule.typo and h % rule.typo == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= rule.letters:
                n[run] = n.get(run, 0) + 1
    n = {w: c for w, c in n.items() if c >= rule.times}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= rule.ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(spark, rows, rule, parts=3):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string").repartition(parts)
    found = spelling.variants(df, rule).collect()
    assert len(found) == len({r["word"] for r in found})
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}


def crowded(seed, n_words, alphabet, sizes):
    """Words that are often one edit apart."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(alphabet), int(rng.choice(sizes)))) for _ in range(n_words // 3)]
    while len(words) < n_words:
        w = list(words[int(rng.integers(len(words)))])
        at, kind = int(rng.integers(len(w))), int(rng.integers(3))
        if kind == 0:
            w[at] = str(rng.choice(list(alphabet)))
        elif kind == 1:
            w.insert(at, str(rng.choice(list(alphabet))))
        elif len(w) > 5:
            del w[at]
        words.append("".join(w))
    return words


@pytest.mark.parametrize("alphabet,sizes", [("ab", [5, 6, 7]), ("abé", [5, 8, 12]), ("abcdeÿß", [5, 6, 30, 61]), ("a", [5, 6, 7, 9])])
@pytest.mark.parametrize("rare", [1, 32])
def test_near_pairs_equal_brute_force(alphabet, sizes, rare):
    """In one process: any dictionary must find every pair, whatever it prunes."""
    words = sorted(set(crowded(3, 240, alphabet, sizes)))
    words = [w for w in words if len(w) >= 5]
    col, n = pa.array(words), pa.array(range(len(words)), pa.int64())
    framed, known = spelling.Framed(col), spelling.Dictionary()
    for size in range(2, 8):
        on = framed.room >= size
        if size > 2:
            on &= known.octaves(size - 1, framed.grams(size - 1)) > 0
        g, c = np.unique(framed.grams(size)[on], return_counts=True)
        known.add(size, g[c > rare], c[c > rare])
    table = pa.Table.from_batches([spelling.entries(col, n, known)]).sort_by("list")
    edges = set()
    for batch in spelling._merge_lists(table.to_batches(max_chunksize=37), least=100):
        edges |= set(zip(batch["word"].to_pylist(), batch["other"].to_pylist()))
    assert edges == {(a, b) for a in words for b in words if edits(a, b)}


def test_words_forms_and_roots_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = crowded(8, 150, "abcé", [5, 6, 9])
    weight = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, 60, p=weight / weight.sum()))) for i in range(120)]
    for rule in (Rule(), Rule(typo=7), Rule(letters=6, times=2, ratio=3, typo=5)):
        assert got(spark, rows, rule) == plain(rows, rule)


def test_nulls_empty_and_very_long_texts_ties_and_repeated_rows(spark):
    rows = [(None, "Hello hello HELLO"), (1, None), (2, ""), (3, " .,1"), (4, "hallo hallo hallo"), (4, "hallo hallo hallo"), (5, "hullo hullo hullo"),
            (6, "jello-jello_jello×jello"), (7, "Éclair ÉCLAIR éclair Éclair"), (8, "x" * 3000 + " " + "y" * 2999), (9, "x" * 3000 + " " + "x" * 3000),
            (10, "y" * 3000 + " " + "y" * 3000 + " " + "x" * 2999 + " " + "x" * 2999 + " " + "x" * 2999), (11, "abÃ\u0080cd cafőe abÃ\u0080cd abÃ\u0080cd"),
            (12, "words " * 50_000 + "wordy " * 5)]
    assert got(spark, rows, Rule()) == plain(rows, Rule())
    assert got(spark, rows * 3, Rule(typo=2)) == plain(rows * 3, Rule(typo=2))
    assert got(spark, [], Rule()) == set() == got(spark, [(1, None)], Rule())


def test_a_hot_prefix_and_long_chains(spark):
    """Thousands of words with one beginning; counts that double along a chain."""
    rng = np.random.default_rng(1)
    hot = ["contra" + "".join(rng.choice(list("abcdef"), 5)) for _ in range(900)]
    chain = ["aaaaaaaa"[:8 - k] + "b" * k for k in range(8)]
    rows = [(i, " ".join([w] * 3)) for i, w in enumerate(hot)] + [(10_000 + k, " ".join([w] * (3 << k))) for k, w in enumerate(chain)]
    found = got(spark, rows, Rule())
    assert found == plain(rows, Rule())
    assert {r[2] for r in found if r[0] in chain} == {chain[-1]}


def test_short_words_and_small_ratios_are_refused(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for rule in (Rule(letters=4), Rule(ratio=1)):
        with pytest.raises(ValueError):
            spelling.variants(df, rule)
