"""N-gram Jaccard join in a metric space: pivots, Voronoi regions, windows.

A text's set holds its distinct n-word shingles (a shorter text: its whole
word sequence).  Two texts link when the Jaccard similarity of their sets
reaches num / den; 1 - similarity is a metric.

1.  Texts with equal sets are one point of the space.
2.  Region pivots.  Linked sets share one of their first shingles in any
    fixed order of all shingles, where "first" is the part of a set beyond
    its least overlap.  The order puts shingles that many documents share
    last, going by a fixed-size sketch of counts over the whole corpus.  Of
    the points that share a first shingle the most central one (fewest
    shingles of its own) is the pivot, and the point belongs to the regions
    of all its pivots: every linked pair meets in a region.
3.  A set's counts in some hash classes of the shingles are coordinates whose
    L1 distance never exceeds the size of the symmetric difference.  A point
    with no other of its region within the distance that a link allows
    leaves the region before any text is moved: first by a sketch of a quarter
    as many classes, then by all of them.  A region of more than
    ``thin_points`` points keeps them all.
4.  A region larger than ``region_shingles`` is divided again: each point
    goes to the Voronoi cell of its nearest pivot and, within the triangle
    inequality's window d(x, p) <= d(x, nearest) + 2 eps, to those of
    others.  What no longer divides is joined block against block.
5.  A region is joined by one task, recursively and exactly.  Points whose
    shingles the others don't share often enough fall away; pivots split the
    rest into cells with windows; a cell that does not split is swept pivot
    by pivot, where the triangle inequality leaves out points whose distances
    to the pivot differ by more than eps, and points already connected.
6.  Connected components of the links give the classes.

Steps 2 to 5 decide only where pairs meet; each link is checked with whole
numbers on the sets.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sifter.llm.common import boxed, discard, small_batches, spans, text_column, written
from sifter.llm.components import components
from sifter.llm.words import WHITE_SPACE, combine, hashed_words, mix

_U = np.uint64
_SLOTS = 1 << 20
_SLICES = 64
_CELLS = 1 << 20  # numbers compared at once
_SPAN, _PIECE = 1 << 18, 1 << 16  # bytes of text at once, and of these hashed at once


@dataclass(frozen=True)
class Rule:
    """Shingle length in words and the least similarity num / den."""

    words: int = 4
    num: int = 85
    den: int = 100

    @property
    def eps(self) -> float:
        return 1 - self.num / self.den


def shingles(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) and the offsets of each text's."""
    words, offsets = hashed_words(col, WHITE_SPACE, _PIECE)
    sizes = np.diff(offsets)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out = np.zeros(int(count.sum()), _U)
    cut = np.r_[0, np.cumsum(count)]
    full = sizes >= n
    if len(words) >= n:
        every = combine([words[k:len(words) - n + 1 + k] for k in range(n)], n)
        start = np.repeat(offsets[:-1][full], count[full])
        step = np.arange(len(start)) - np.repeat(np.r_[0, np.cumsum(count[full])][:-1], count[full])
        out[np.repeat(full, count)] = every[start + step]
    for i in np.flatnonzero((sizes > 0) & ~full):
        out[cut[i]] = combine([words[j:j + 1] for j in range(offsets[i], offsets[i + 1])], 1000 + int(sizes[i]))[0]
    return out, cut


def shingle_sets(col: pa.Array, n: int):
    """The sorted distinct shingles of each text, in bounded portions."""
    _, cut = text_column(col)
    for lo, hi in spans(cut, _SPAN):
        h, at = shingles(col.slice(lo, hi - lo), n)
        for i in range(hi - lo):
            yield np.unique(h[at[i]:at[i + 1]])


# --- fixed-size sketches ------------------------------------------------------

def _sliced(df: DataFrame, count) -> np.ndarray:
    """Add up one array of ``_SLOTS`` counters over all rows: every task counts
    in its own array, slices of it are summed by their number, and the fixed
    total (8 MB) comes to the driver."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def local(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            count(batch, total)
        for k, part in enumerate(np.split(total, _SLICES)):
            if part.any():
                wide = "<i4" if part.max() < 1 << 31 else "<i8"
                yield pa.RecordBatch.from_pylist([{"slice": k, "counts": wide.encode() + part.astype(wide).tobytes()}], schema)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_SLOTS // _SLICES, np.int64)
        for c in table["counts"]:
            raw = c.as_py()
            total += np.frombuffer(raw, raw[:3].decode(), offset=3)
        return pa.Table.from_pylist([{"slice": table["slice"][0].as_py(), "counts": b"<i8" + total.tobytes()}], schema)

    ddl = "slice int, counts binary"
    out = np.zeros((_SLICES, _SLOTS // _SLICES), np.int64)
    for r in df.mapInArrow(local, ddl).groupBy("slice").applyInArrow(add, ddl).collect():
        out[r["slice"]] = np.frombuffer(bytes(r["counts"]), "<i8", offset=3)
    return out.ravel()


def commonness(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Class per sketch slot: 0 as frequent as chance allows, then by octaves
    of the excess.  The classes steer only the order of shingles."""
    def count(batch, total):
        col = batch.column(0)
        _, cut = text_column(col)
        for lo, hi in spans(cut, _SPAN):
            h, _ = shingles(col.slice(lo, hi - lo), rule.words)
            np.add.at(total, (h & _U(_SLOTS - 1)).astype(np.int64), 1)

    counts = _sliced(docs.select("text"), count)
    middle = float(np.median(counts))
    excess = (counts - middle) / (5 * np.sqrt(middle + 1))
    return np.where(excess <= 1, 0, 1 + np.log2(np.maximum(excess, 1))).astype(np.uint8)


def _slots(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (mix(numbers.view(_U)) >> _U(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """A set of 64-bit numbers as 2 ** ``bits`` bits."""

    bits: int
    words: np.ndarray

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        slot = _slots(numbers, self.bits)
        return (self.words[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _filter(numbers: DataFrame) -> Filter:
    """The filter of a column of longs: 16 bits or more a number, but 2**27 (16
    MB) at most, from where on more strangers pass.  Every slice of the slots is
    made by one task, so what moves to the driver is the filter, once."""
    bits = min(27, max(16, (16 * numbers.count()).bit_length()))
    shift, part = bits - (_SLICES.bit_length() - 1), (1 << bits - 3) // _SLICES

    def slot(batches):
        for batch in batches:
            at = np.unique(_slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> shift).astype(np.int32)), pa.array(at)], names=["slice", "slot"])

    def mark(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            which, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(which).tolist():
                mine = at[which == k] - (k << shift)
                np.bitwise_or.at(found.setdefault(k, np.zeros(part, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        for k, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["slice", "words"])

    slots = numbers.mapInArrow(slot, "slice int, slot long").repartition("slice")
    words = np.zeros((_SLICES, part), np.uint8)
    for r in slots.mapInArrow(mark, "slice int, words binary").collect():
        words[r["slice"]] = np.frombuffer(bytes(r["words"]), np.uint8)
    return Filter(bits, words.ravel())


def _maybe(ids: DataFrame):
    """A filter that admits every row whose id is one of ``ids`` and few others."""
    wanted = ids.sparkSession.sparkContext.broadcast(_filter(ids))

    @F.arrow_udf("boolean")
    def maybe(col: pa.Array) -> pa.Array:
        return pa.array(wanted.value.holds(col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))

    return maybe


# --- points ---------------------------------------------------------------------

def least_overlap(n, rule: Rule):
    """A linked partner shares at least this many of n shingles."""
    return -(-rule.num * n // rule.den)


def coordinates(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles in 64 to 4096 hash classes, about one per
    eight shingles; half as many classes are sums of neighbours."""
    classes = min(4096, max(64, 1 << int(len(s) / 8).bit_length()))
    shift = _U(64 - (classes.bit_length() - 1))
    return np.minimum(np.bincount((mix(s) >> shift).astype(np.int64), minlength=classes), 65535).astype("<u2")


def sketch(coords: np.ndarray) -> np.ndarray:
    """The coordinates in a quarter as many classes, 16 at least."""
    return coords.reshape(max(16, len(coords) // 4), -1).sum(axis=1).astype("<u4").clip(max=65535).astype("<u2")


def plausible(n: np.ndarray, coords: list[np.ndarray], rule: Rule, block: int = 64) -> np.ndarray:
    """Which points have another one that the coordinates do not rule out.
    Pairs of points that both have one already are not compared any more."""
    order = np.argsort(n, kind="stable")
    size, kinds = n[order], np.array([len(coords[i]) for i in order])
    out = np.zeros(len(n), bool)  # by place in the order
    at = 0
    while at < len(n):
        stop = min(at + block, len(n), int(np.searchsorted(kinds, kinds[at], "right")))
        last = int(np.searchsorted(size, size[stop - 1] * rule.den // rule.num, "right"))
        k = kinds[at]
        classes = lambda rows: np.array([coords[order[i]].reshape(k, -1).sum(axis=1) for i in rows], np.int32)
        mine = classes(range(at, stop))
        width = max(1, _CELLS // (block * int(k)))  # a long set has thousands of classes
        for lo in range(at, last, width):
            rows = np.arange(lo, min(lo + width, last))
            if out[at:stop].all():
                rows = rows[~out[rows]]
            if not len(rows):
                continue
            apart = np.abs(mine[:, None, :] - classes(rows)[None, :, :]).sum(axis=2)
            near = apart * (rule.den + rule.num) <= (rule.den - rule.num) * (size[at:stop, None] + size[None, rows])
            near &= rows[None, :] != np.arange(at, stop)[:, None]
            out[at:stop] |= near.any(axis=1)
            out[rows] |= near.any(axis=0)
        at = stop
    back = np.zeros(len(n), bool)
    back[order] = out
    return back


def points(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, n, sig_a, sig_b, odd, first, coords, sketch): set size, set signature,
    share of shingles that are no common ones (0 to 100), first shingles,
    coordinates and their sketch."""
    common = docs.sparkSession.sparkContext.broadcast(commonness(docs, rule))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("odd", pa.int32()), ("first", pa.list_(pa.int64())), ("coords", pa.binary()), ("sketch", pa.binary())])

    def point(batches):
        classes = common.value
        for batch in batches:
            n, a, b, odd, first, coords, light = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), rule.words):
                c = classes[(s & _U(_SLOTS - 1)).astype(np.int64)]
                keep = len(s) - least_overlap(len(s), rule) + 1 if len(s) else 0
                n.append(len(s))
                a.append(int(mix(s).sum(dtype=_U).astype(np.int64)))
                b.append(int(mix(s ^ _U(0xA5A5A5A5DEADBEEF)).sum(dtype=_U).astype(np.int64)))
                odd.append(int(100 * np.mean(c == 0)) if len(s) else 0)
                first.append(s[np.argsort(c, kind="stable")[:keep]].view(np.int64))
                whole = coordinates(s)
                coords.append(whole.tobytes())
                light.append(sketch(whole).tobytes())
            found = [n, a, b, odd, first, coords, light]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, f.type) for x, f in zip(found, list(schema)[1:])]], schema=schema)

    # no UDF: beside one, Spark would keep every text until its row's result is back
    return docs.select("id", "text").mapInArrow(point, "id long, n long, sig_a long, sig_b long, odd int, first array<long>, coords binary, sketch binary")


# --- joining a region in one task ----------------------------------------------------

class Region:
    """Sets of one region; ``label`` is the smallest position connected so far."""

    def __init__(self, sets: list[np.ndarray], central: np.ndarray, rule: Rule):
        self.rule = rule
        self.size = np.array([len(s) for s in sets], np.int64)
        self.label = np.arange(len(sets))
        self.central = central
        row = np.repeat(np.arange(len(sets)), self.size)
        _, shingle, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if len(sets) else (None, row, row)
        alive = np.ones(len(sets), bool)
        need = least_overlap(self.size, rule)
        while True:  # a point links with none if too few of its shingles are shared
            shared = df[shingle] > 1
            left = alive & (np.bincount(row[shared], minlength=len(sets)) >= need)
            if left.sum() == alive.sum():
                break
            alive = left
            on = alive[row]
            row, shingle = row[on], shingle[on]
            df = np.bincount(shingle, minlength=len(df))
        on = df[shingle] > 1
        row, shingle = row[on], shingle[on]
        self.alive = np.flatnonzero(alive)
        order = np.argsort(shingle, kind="stable")
        self.posted = row[order]
        self.ends = np.cumsum(np.bincount(shingle, minlength=len(df)))
        self.row_at = np.r_[0, np.cumsum(np.bincount(row, minlength=len(sets)))]
        self.row_shingles = shingle[np.argsort(row, kind="stable")]

    def overlaps(self, p: int) -> np.ndarray:
        """Shared shingles of point p with every point."""
        own = self.row_shingles[self.row_at[p]:self.row_at[p + 1]]
        stop = self.ends[own]
        start = np.where(own > 0, self.ends[own - 1], 0)
        n = stop - start
        take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        return np.bincount(self.posted[take], minlength=len(self.size))

    def distances(self, p: int, among: np.ndarray) -> np.ndarray:
        """Distances of ``among`` to p; connects those that link with it."""
        common = self.overlaps(p)[among]
        union = self.size[among] + self.size[p] - common
        linked = among[self.rule.den * common >= self.rule.num * union]
        if len(linked):
            marks = np.unique(np.r_[self.label[linked], self.label[p]])
            if len(marks) > 1:
                self.label[np.isin(self.label, marks)] = marks[0]
        return 1 - common / np.maximum(union, 1)

    def join(self, cell: np.ndarray | None = None, n_pivots: int = 4, small: int = 48) -> np.ndarray:
        """Connect all linked points of a cell; returns the labels."""
        todo = [self.alive if cell is None else cell]
        while todo:
            cell = todo.pop()
            if len(cell) < 2 or (self.label[cell] == self.label[cell[0]]).all():
                continue
            if len(cell) > small:
                parts = self.divide(cell, n_pivots)
                if parts is not None:
                    todo += parts
                    continue
            self.sweep(cell)
        return self.label

    def divide(self, cell: np.ndarray, n_pivots: int) -> list[np.ndarray] | None:
        """Voronoi cells with windows, or None if the windows hold too much."""
        pivots = [int(cell[np.argmin(self.central[cell])])]
        dist = [self.distances(pivots[0], cell)]
        while len(pivots) < n_pivots:
            near = np.min(dist, axis=0)
            if near.max() <= 0:
                break
            pivots.append(int(cell[near.argmax()]))
            dist.append(self.distances(pivots[-1], cell))
        d = np.array(dist)
        inside = d <= d.min(axis=0) + 2 * self.rule.eps + 1e-9
        if inside.sum() > 1.5 * len(cell) or inside.sum(axis=1).max() > 0.9 * len(cell):
            return None
        return [cell[row] for row in inside]

    def sweep(self, cell: np.ndarray) -> None:
        """Pivot by pivot.  Points within eps of the pivot are connected with
        it, so of their pairs only those with other points stay open, and of
        these only the ones whose distances to the pivot differ by eps at most."""
        left = cell[np.argsort(self.central[cell], kind="stable")]
        while len(left) > 1:
            pivot, left = int(left[0]), left[1:]
            d = self.distances(pivot, left)
            own = self.label[left] == self.label[pivot]
            if own.all():
                return
            # a point stays if one of another class lies in its window
            other = np.sort(d[~own])
            at = np.searchsorted(other, d - self.rule.eps - 1e-9)
            stays = ~own | ((at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= d + self.rule.eps + 1e-9))
            left = np.r_[left[stays & ~own], left[stays & own]]


def _read_region(table: pa.Table, rule: Rule) -> tuple[np.ndarray, Region]:
    ids = table["id"].to_numpy()
    sets = list(shingle_sets(table["text"].combine_chunks(), rule.words))
    return ids, Region(sets, table["odd"].to_numpy(), rule)


def _join_region(rule: Rule):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def join(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.Table.from_pylist([], schema)
        ids, region = _read_region(table, rule)
        label = region.join()
        on = label != np.arange(len(label))
        return pa.table({"u": ids[on], "v": ids[label[on]]}, schema=schema)

    return join


# --- regions across tasks -----------------------------------------------------------

def _key():
    """A set's rank key: the most central sets first, then by their hash."""
    return F.shiftleft(F.col("odd").cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64("n", "sig_a", "sig_b"), 8))


def regions(pts: DataFrame) -> DataFrame:
    """(region, key): every set in the regions of its pivots.  The key is a
    function of the set, so the copies of a text fall together in the
    aggregations and their long rows need no shuffle before.  Two sets share a
    key only with a probability of about 2**-56 per pair, which merges two
    regions.  Shingles that one set alone has (most of them) are left out by a
    filter of the shared ones before the second shuffle."""
    entry = pts.select(_key().alias("key"), F.explode("first").alias("s"))
    pivot = written(entry.groupBy("s").agg(F.min("key").alias("region"), F.count("*").alias("c")).where("c > 1").drop("c"), "pivots")
    shared = pts.sparkSession.sparkContext.broadcast(_filter(pivot.select("s")))

    def only_shared(batches):
        for batch in batches:
            col = batch.column(1)
            s = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            on = shared.value.holds(s)
            key = np.repeat(batch.column(0).to_numpy(), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(s[on])], names=["key", "s"])

    # no UDF: Spark would push a copy of it below explode as a filter, and run two workers in every task
    entry = pts.select(_key().alias("key"), "first").mapInArrow(only_shared, "key long, s long")
    return written(entry.join(pivot, "s").select("region", "key").distinct(), "regions")


def _thinned(members: DataFrame, rule: Rule, by: str) -> DataFrame:
    """Regions without the points that link with none of their region, as far as
    the column ``by`` tells."""
    ddl = "region long, id long, n long, odd int"
    schema = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("odd", pa.int32())])

    def thin(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.Table.from_pylist([], schema)
        coords = [np.frombuffer(c, "<u2") for c in table[by].to_pylist()]
        return table.select(schema.names).filter(pa.array(plausible(table["n"].to_numpy(), coords, rule))).cast(schema)

    return members.groupBy("region").applyInArrow(thin, ddl)


def _heavy(members: DataFrame, limit: int) -> DataFrame:
    return members.groupBy("region").agg(F.sum("n").alias("weight"), F.count("*").alias("size")).where(F.col("weight") > limit)


def _divide(members: DataFrame, heavy: DataFrame, texts: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """One level of Voronoi cells for the heavy regions.  A region's points
    are dealt into blocks, each of which gets the pivots' texts (about eight
    per region, drawn by hash, and the most central point's hash class)."""
    big = members.join(heavy, "region").join(texts, "id")
    n_blocks = F.ceil(F.col("weight") / F.lit(limit)).cast("int")
    drawn = F.pmod(F.xxhash64(F.lit(3), "id"), F.greatest(F.lit(1), F.floor(F.col("size") / 8))) == 0
    rows = big.select("region", F.pmod(F.xxhash64(F.lit(5), "id"), n_blocks).cast("int").alias("block"), "id", "n", "odd", "text", F.lit(False).alias("pivot"))
    pivots = big.where(drawn).select("region", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), "id", "n", "odd", "text", F.lit(True).alias("pivot"))
    schema = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("odd", pa.int32())])

    def assign(table: pa.Table) -> pa.Table:
        is_pivot = table["pivot"].to_numpy(zero_copy_only=False)
        own, region = table.filter(pa.array(~is_pivot)), table["region"][0].as_py()
        if not own.num_rows:
            return pa.Table.from_pylist([], schema)
        ids = table["id"].to_numpy()
        sets = list(shingle_sets(table["text"].combine_chunks(), rule.words))
        at, mine = np.flatnonzero(is_pivot), np.flatnonzero(~is_pivot)
        at = at[np.argsort(ids[at], kind="stable")]
        d = np.ones((len(at), len(mine)))
        flat = np.concatenate([sets[i] for i in mine])
        sizes = np.array([len(sets[i]) for i in mine])
        cut = np.r_[0, np.cumsum(sizes)]
        for k, p in enumerate(at):
            slot = np.minimum(np.searchsorted(sets[p], flat), len(sets[p]) - 1)
            common = np.diff(np.r_[0, np.cumsum(sets[p][slot] == flat)][cut])
            d[k] = 1 - common / (sizes + len(sets[p]) - common)
        inside = d <= d.min(axis=0) + 2 * rule.eps + 1e-9 if len(at) else np.ones((1, len(mine)), bool)
        numbers = mix(np.r_[ids[at], [0]].astype(np.int64).view(_U) + _U(region & ((1 << 64) - 1))).view(np.int64)
        cells, who = np.nonzero(inside)
        pick = mine[who]
        return pa.table({"region": numbers[cells], "id": ids[pick], "n": table["n"].to_numpy()[pick], "odd": table["odd"].to_numpy()[pick]}, schema=schema)

    cells = rows.unionByName(pivots).groupBy("region", "block").applyInArrow(assign, "region long, id long, n long, odd int")
    return cells


def _block_pairs(members: DataFrame, heavy: DataFrame, limit: int) -> DataFrame:
    """Heavy regions as pairs of blocks: every two points meet in one pair."""
    big = members.join(heavy, "region")
    half = F.ceil(2 * F.col("weight") / F.lit(limit)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(5), "id"), half).cast("int")
    other = F.explode(F.sequence(F.lit(0), half - 1)).alias("o")
    rows = big.select("region", "id", "n", "odd", block.alias("b"), other)
    pair = F.xxhash64("region", F.least("b", "o"), F.greatest("b", "o"))
    return rows.select(pair.alias("region"), "id", "n", "odd")


def links(docs: DataFrame, found: DataFrame, classes: DataFrame, rule: Rule, region_shingles: int, levels: int, thin_points: int) -> DataFrame:
    """(u, v) representatives that connect all linked classes of equal sets.
    ``found`` are the regions (region, key)."""
    point = lambda *by: classes.select(_key().alias("key"), F.col("rep").alias("id"), *by)
    crowded = written(found.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > thin_points), "crowded").select("region")
    light = found.join(crowded, "region", "left_anti").join(point("n", "odd", "sketch"), "key")
    first = written(_thinned(light, rule, "sketch"), "thin")
    some = _maybe(first.select("id").distinct())
    coords = classes.select(F.col("rep").alias("id"), "coords").where(some("rep"))
    rest = found.join(crowded, "region", "left_semi").join(point("n", "odd"), "key").select("region", "id", "n", "odd")
    members = written(_thinned(first.join(coords, "id"), rule, "coords").unionByName(rest), "members")
    discard(first)
    texts = docs.where(_maybe(members.select("id").distinct())("id"))
    for level in range(levels + 1):
        heavy = written(_heavy(members, region_shingles), "heavy")
        if heavy.isEmpty():
            break
        light = members.join(heavy.select("region"), "region", "left_anti")
        split = (_divide(members, heavy, texts, rule, region_shingles) if level < levels
                 else _block_pairs(members, heavy, region_shingles))
        before, members = members, written(light.unionByName(split), "members")
        discard(before)
    rows = members.select("region", "id", "odd").join(texts, "id")
    return written(rows.groupBy("region").applyInArrow(_join_region(rule), "u long, v long"), "links")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text",
                    region_shingles: int = 1_000_000, levels: int = 2, thin_points: int = 50_000) -> DataFrame:
    """(``id_col``, n_shingles, component_id) per row of ``docs``.

    The component is the smallest id reachable by links, the own id included.
    A null or blank text has no shingles and links with nothing.  Rows that
    share an id are one node, so they share a component; a row without id has
    its set counted, links with nothing and has a null component.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pts = written(points(source, rule), "points")
    usable = pts.where((F.col("n") > 0) & F.col("id").isNotNull())
    sets = ["n", "sig_a", "sig_b"]
    # odd, coords and sketch are functions of the set, so they ride along as keys
    classes = written(usable.groupBy(*sets, "odd", "coords", "sketch").agg(F.min("id").alias("rep")), "classes")
    found_in = regions(usable)
    heads = written(pts.select("id", *sets), "sets")
    discard(pts)
    same = classes.select(*sets, "rep")
    found = links(source.where("id is not null"), found_in, classes, rule, region_shingles, levels, thin_points)
    discard(found_in)
    # rows that share an id tie the classes of their sets together
    tied = written(heads.where("n > 0 and id is not null").join(same, sets).select("id", "rep"), "tied")
    several = tied.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    ties = tied.join(several, "id").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    label = components(found.unionByName(ties))
    best = (tied.join(label.withColumnRenamed("id", "rep"), "rep", "left")
            .groupBy("id").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id")))
    out = heads.select("id", "n").join(best, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_per_group(docs: DataFrame, rule: Rule, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group of
    linked texts stays, the one with the smallest id (rows without id last).

    Rows are told apart by a hash of id and text, so rows that share an id but
    not the text are rows of their own, and copies without id are found.  Rows
    equal in both are one if they have words; texts without words all stay.
    Rows that are surely in no group pass without a shuffle.
    """
    rows = boxed(docs, id=F.col(f"`{id_col}`"), text=F.col(f"`{text_col}`"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    found = written(near_duplicates(rows.select("key", "text"), rule, id_col="key").where("n_shingles > 0"), "near")
    several = found.groupBy("component_id").agg(F.count("*").alias("c")).where("c > 1").select("component_id")
    touched = written(found.join(several, "component_id").select("key", F.col("component_id").alias("group")).distinct(), "touched")
    discard(found)
    maybe = _maybe(touched.select("key"))
    rows = rows.withColumn("maybe", maybe("key"))
    in_group = rows.where("maybe").select("_row", "id", "key").join(touched, "key", "left")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    chosen = written(in_group.where("group is not null").groupBy("group").agg(first).select(F.col("first.key").alias("key"), F.lit(True).alias("chosen")), "chosen")
    kept = in_group.join(chosen, "key", "left")
    one = kept.where("chosen").groupBy("key").agg(F.min("_row").alias("_row"))
    return (rows.where("not maybe").select("_row.*").unionByName(kept.where("group is null").select("_row.*"))
            .unionByName(one.select("_row.*")))
