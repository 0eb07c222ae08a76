"""Benchmark decontamination with suffix arrays of the training documents.

Words are lower-cased (A-Z) runs of ASCII letters and digits and of other
characters from U+0080.  An item's windows are its runs of ``window`` words;
an item of fewer words, but not none, is one window.

Each shard of documents gets a suffix array: the start positions whose first
few words occur somewhere in the benchmark, sorted by the words that follow
(up to a window; other suffixes can match no window).  Every test suffix
that begins a window is binary-searched in it, a window that an item repeats
once.  Its hits on neighbouring positions of one alignment are joined to the
longest verbatim match; where an item repeats windows, the matches are the longest
ones that cover the document's hits from left to right.

The benchmark is read in blocks of at most ``block_bytes`` of text (a longer
item stands alone), each broadcast and searched in the same scan, one after
the other; the driver and a search hold one block at a time.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sifter.llm.common import boxed, spans, text_column
from sifter.llm.words import NOT_ALNUM, combine, hashed_words

_SPAN, _PIECE = 1 << 18, 1 << 16  # bytes of text at once, and of these hashed at once
_MATCH = "array<struct<item_id:string,item_pos:int,doc_pos:int,n_words:int>>"
_ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_pos", pa.int32()), ("doc_pos", pa.int32()), ("n_words", pa.int32())]))


class TestSuffixes:
    """The suffixes of a block of items that begin a window, as sorted keys."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        hashes, offsets = hashed_words(pa.array([t for _, t in items], pa.string()), NOT_ALNUM)
        sizes = np.diff(offsets)
        self.window = window
        self.vocabulary, rank = np.unique(hashes, return_inverse=True)
        need = np.minimum(sizes, window)
        self.head = int(min(3, need[need > 0].min(initial=window)))
        count = np.where(need > 0, sizes - need + 1, 0)  # windows of each item
        item = np.repeat(np.arange(len(items)), count)
        pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows, self.length = range(len(item)), need[item].astype(np.int64)
        at = offsets[item] + pos if len(rows) else np.zeros(0, np.int64)
        step = np.arange(window)
        inside = step[None, :] < self.length[:, None]
        words = np.where(inside, (rank + 1)[np.minimum(at[:, None] + step, max(len(rank) - 1, 0))] if rows else 0, 0)
        low = _keys(words.reshape(len(rows), window))
        high = _keys(np.where(inside, words, 0xFFFFFFFF).reshape(len(rows), window))
        # a window that an item repeats is searched once; ``at_window`` has its places in the item
        order = np.lexsort((pos, low, item)) if len(rows) else np.zeros(0, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (item[order][1:] != item[order][:-1]) | (low[order][1:] != low[order][:-1])
        first = np.flatnonzero(new)
        self.places, self.at_window = pos[order], np.r_[first, len(order)]
        one = order[first]
        self.item, self.pos, self.length, self.low, self.high = item[one], pos[one], self.length[one], low[one], high[one]
        self.repeats = np.zeros(len(items), bool)
        self.repeats[self.item[np.diff(self.at_window) > 1]] = True
        self.heads = np.unique(_head_hashes(hashes, at, self.head)) if rows else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.heads & np.uint64(0xFFFFF)).astype(np.int64)] = True
        names, self.name_of = np.unique(np.array([i for i, _ in items], object).astype(str), return_inverse=True)
        self.names = names.tolist()


def _keys(words: np.ndarray) -> np.ndarray:
    """Word numbers of a suffix as bytes that sort like the word sequence."""
    wide = np.ascontiguousarray(words.astype(">u4"))
    return wide.view(f"S{4 * wide.shape[1]}").ravel() if len(wide) else np.zeros(0, f"S{4 * wide.shape[1]}")


def _head_hashes(hashes: np.ndarray, at: np.ndarray, head: int) -> np.ndarray:
    return combine([hashes[at + k] for k in range(head)], head)


def shard_matches(hashes: np.ndarray, offsets: np.ndarray, test: TestSuffixes):
    """Longest matches in one shard: arrays (document, item, item_pos, doc_pos,
    n_words), in document order."""
    none = (np.zeros(0, np.int64),) * 5
    n = len(hashes)
    if n < test.head or not len(test.low):
        return none
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(n) + test.head <= ends)
    head = _head_hashes(hashes, at, test.head)
    some = test.filter[(head & np.uint64(0xFFFFF)).astype(np.int64)]
    at, head = at[some], head[some]
    slot = np.minimum(np.searchsorted(test.heads, head), len(test.heads) - 1)
    at = at[test.heads[slot] == head]
    if not len(at):
        return none
    # the suffix array: word numbers of up to a window, cut at unknown words and the text's end
    span = at[:, None] + np.arange(test.window)
    got = hashes[np.minimum(span, n - 1)]
    slot = np.minimum(np.searchsorted(test.vocabulary, got), len(test.vocabulary) - 1)
    known = (test.vocabulary[slot] == got) & (span < ends[at][:, None])
    words = np.where(np.logical_and.accumulate(known, axis=1), slot + 1, 0)
    keys = _keys(words)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = at[order], keys[order]
    lo, hi = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    times = hi - lo
    which = np.repeat(np.arange(len(times)), times)
    if not len(which):
        return none
    where = suffixes[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)]
    # neighbouring hits of one alignment are one longer match
    item, ipos, width = test.item[which], test.pos[which], test.length[which]
    order = np.lexsort((where, where - ipos, item))
    order = order[~test.repeats[item[order]]]
    twisted = np.flatnonzero(test.repeats[item])
    twisted = twisted[np.lexsort((where[twisted], item[twisted]))]
    loops = _repeating_matches(item[twisted], where[twisted], which[twisted], ends, test)
    item, ipos, where, width = item[order], ipos[order], where[order], width[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (where[1:] != where[:-1] + 1) | (ipos[1:] != ipos[:-1] + 1) | (ends[where[1:]] != ends[where[:-1]])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(item)] - 1
    size = (where[last] - where[first] + width[last]) if len(first) else np.zeros(0, np.int64)
    item, ipos, where, size = (np.concatenate(x) for x in zip((item[first], ipos[first], where[first], size), loops))
    doc = np.searchsorted(offsets, where, "right") - 1
    order = np.lexsort((ipos, item, where))
    return tuple(x[order] for x in (doc, item, ipos, where - offsets[doc], size))


def _repeating_matches(item: np.ndarray, where: np.ndarray, window: np.ndarray, ends: np.ndarray, test: TestSuffixes) -> tuple:
    """Matches with items that repeat a window: arrays (item, item_pos, place, n_words).

    The hits come by item and place.  A match goes on while some place in the item
    goes on with it, so the pairs of places never are written out.  From the
    first place on, each match is the longest that covers the next place not
    covered yet, extended to the left as well."""
    def places(k: int) -> np.ndarray:
        return test.places[test.at_window[window[k]]:test.at_window[window[k] + 1]]

    def follows(k: int) -> bool:  # hit k goes on from hit k - 1
        return item[k] == item[k - 1] and where[k] == where[k - 1] + 1 and ends[where[k]] == ends[where[k - 1]]

    out, at = [], 0
    while at < len(item):
        last, now = at, places(at)
        while last + 1 < len(item) and follows(last + 1):
            longer = np.intersect1d(now + 1, places(last + 1), assume_unique=True)
            if not len(longer):
                break
            last, now = last + 1, longer
        first, start = at, now - (last - at)
        while first and follows(first):
            longer = np.intersect1d(start - 1, places(first - 1), assume_unique=True)
            if not len(longer):
                break
            first, start = first - 1, longer
        out.append((item[at], start.min(), where[first], last - first + test.length[window[at]]))
        at = last + 1
    return tuple(np.array([m[k] for m in out], np.int64) for k in range(4))


def _search(test) -> Column:
    @F.arrow_udf(f"struct<n_words:bigint,matches:{_MATCH}>")
    def search(col: pa.Array) -> pa.Array:
        t = test.value
        sizes, lists = np.zeros(len(col), np.int64), [[]] * len(col)
        _, cut = text_column(col)
        for lo, hi in spans(cut, _SPAN):
            hashes, offsets = hashed_words(col.slice(lo, hi - lo), NOT_ALNUM, _PIECE)
            sizes[lo:hi] = np.diff(offsets)
            found: dict[int, list] = {}
            for d, i, p, w, n in zip(*(x.tolist() for x in shard_matches(hashes, offsets, t))):
                found.setdefault(d, []).append({"item_id": t.names[t.name_of[i]], "item_pos": p, "doc_pos": w, "n_words": n})
            for d, m in found.items():
                lists[lo + d] = m
        return pa.StructArray.from_arrays([pa.array(sizes), pa.array(lists, _ARROW_MATCH)], names=["n_words", "matches"])

    return search


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Blocks of (id, text); the items arrive one partition at a time."""
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def find_matches(docs: DataFrame, bench: DataFrame, *, window: int = 10, id_col: str = "item_id", item_text: str = "text",
                 text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``docs`` with ``_n_words`` and ``_matches`` (columns of these
    names and ``_found`` are replaced), the longest
    verbatim matches of a window or more (item_id, item_pos, doc_pos, n_words).

    A null text has no words; an item without id is named ''.  Items that
    share an id count as one.  An empty benchmark matches nothing.
    """
    spark = docs.sparkSession
    out = docs.withColumn("_matches", F.expr(f"cast(array() as {_MATCH})")).withColumn("_n_words", F.lit(0).cast("long"))
    blocks = _blocks(bench, id_col, item_text, block_bytes)  # the driver holds one at a time
    for block in itertools.chain([next(blocks, [])], blocks):
        test = spark.sparkContext.broadcast(TestSuffixes(block, window))
        out = out.withColumn("_found", _search(test)(F.col(text_col)))
        out = out.withColumn("_matches", F.concat("_matches", "_found.matches")).withColumn("_n_words", F.col("_found.n_words")).drop("_found")
    return out


def n_hit(matches: Column) -> Column:
    """Words covered by the union of the matches."""
    parts = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_pos"].alias("s"), (m["doc_pos"] + m["n_words"]).alias("e"))))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(parts, start, lambda a, m: F.struct(
        F.greatest(a["upto"], m["e"]).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), m["e"] - F.greatest(a["upto"], m["s"]))).cast("long").alias("n")))["n"]


def item_ids(matches: Column) -> Column:
    """The distinct item ids, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))


def remove_contaminated(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without any match."""
    rows = boxed(docs, text=F.col(kw.pop("text_col", "text")))
    return find_matches(rows, bench, **kw).where(F.size("_matches") == 0).select("_row.*")
