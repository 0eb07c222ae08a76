"""Exact top-k search by inner product with ball trees.

Every shard of the vectors gets one ball tree.  A block of queries descends
a tree level by level: a node with centre c and radius r bounds the score of
a query q by ``q.c + |q| r``, a node whose bound is below the query's
current k-th score is dropped, and the leaves that stay are opened in the
order of their bounds while the k-th score rises.  Shards are searched in
waves; the k-th scores that one wave ends with are shared with all shards of
the next, where most nodes then fall at once.

Defined results.  A component x becomes floor(256 x).  A vector takes no
part if it or its id is null or if a component is null, not finite or so large
that its integer is no long.  Scores are exact; one beyond a long counts as the
end of the longs on its side.  Only vectors of equal length meet.  Rows that share an id count
once, with the smallest vector.  Equal scores rank by the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from sifter.llm.common import written

_DEEP = np.iinfo(np.int64).min
_HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, q array<long>, dim) of the vectors that take part."""
    x = F.col(vec_col)
    good: Column = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < 2.0**63 / scale))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q")).withColumn("dim", F.size("q"))


def exact_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of rows of longs, clipped to the longs.

    Arithmetic modulo 2**64 is right wherever the sum of the terms' sizes stays
    below 2**62; the other pairs are computed with Python's integers."""
    with np.errstate(over="ignore"):
        out = queries @ points.T
    sizes = np.abs(queries.astype(np.float64)) @ np.abs(points.astype(np.float64)).T
    ends = np.iinfo(np.int64)
    for i, j in zip(*np.nonzero(sizes >= 2.0**62)):
        whole = sum(a * b for a, b in zip(queries[i].tolist(), points[j].tolist()))
        out[i, j] = min(max(whole, ends.min + 1), ends.max)
    return out


class BallTree:
    """Ball tree of one shard, kept as flat arrays so that it travels as bytes."""

    FIELDS = ("ids", "points", "lo", "hi", "left", "centre", "radius")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, k: int, leaf: int) -> BallTree:
        """Of equal vectors only the k + 1 smallest ids can be among a query's
        best k, as one more may be the query itself; the others are left out."""
        order = np.lexsort((*points.T[::-1], ids)) if points.shape[1] else np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        keep = np.r_[True, ids[1:] != ids[:-1]]  # the smallest vector of each id
        ids, points = ids[keep], points[keep]
        _, group = np.unique(points, axis=0, return_inverse=True)
        order = np.lexsort((ids, group.ravel()))
        g = group.ravel()[order]
        first = np.searchsorted(g, g)
        order = order[np.arange(len(g)) - first <= k]
        ids, points = ids[order], points[order]
        real = points.astype(np.float64)
        perm = np.arange(len(ids))
        nodes, todo = [], [(0, len(ids), -1)]
        lo, hi, left, centre, radius = [], [], [], [], []
        while todo:
            a, b, parent = todo.pop(0)
            me = len(lo)
            if parent >= 0 and left[parent] < 0:
                left[parent] = me
            rows = perm[a:b]
            c = real[rows].mean(axis=0)
            dist = np.sqrt(((real[rows] - c) ** 2).sum(axis=1))
            lo.append(a)
            hi.append(b)
            left.append(-1)
            centre.append(c)
            radius.append(dist.max(initial=0.0))
            if b - a > leaf and radius[-1] > 0:
                far = real[rows[dist.argmax()]]
                other = real[rows[((real[rows] - far) ** 2).sum(axis=1).argmax()]]
                half = (b - a) // 2
                perm[a:b] = rows[np.argpartition((real[rows] * (other - far)).sum(axis=1), half)]
                todo += [(a, a + half, me), (a + half, b, me)]
        return cls(ids=ids[perm], points=points[perm], lo=np.array(lo), hi=np.array(hi), left=np.array(left),
                   centre=np.array(centre).reshape(len(lo), -1), radius=np.array(radius))

    def search(self, qids: np.ndarray, queries: np.ndarray, best: np.ndarray, bestid: np.ndarray) -> None:
        """Improve each query's k best (score, id), sorted from the best down.

        All queries walk the levels together.  The children of a node follow
        one another, so ``left`` names both.
        """
        k = best.shape[1]
        real = queries.astype(np.float64)
        norm = np.sqrt((real**2).sum(axis=1))
        slack = 1e-9 * (1 + norm)  # rounding of the bounds
        scale = np.abs(self.centre).max(initial=0.0) + self.radius.max(initial=0.0) + 1
        front_q, front_n = np.arange(len(qids)), np.zeros(len(qids), np.int64)
        leaves: list[tuple] = []
        while len(front_q):
            bound = np.empty(len(front_q))
            for part in np.array_split(np.arange(len(front_q)), max(1, len(front_q) >> 15)):
                bound[part] = np.einsum("ij,ij->i", real[front_q[part]], self.centre[front_n[part]])
            bound += norm[front_q] * self.radius[front_n] + slack[front_q] * scale
            bound = np.maximum(bound, float(_DEEP))  # scores end there too
            live = bound >= best[front_q, -1]
            front_q, front_n, bound = front_q[live], front_n[live], bound[live]
            is_leaf = self.left[front_n] < 0
            leaves.append((front_q[is_leaf], front_n[is_leaf], bound[is_leaf]))
            front_q, kids = front_q[~is_leaf], self.left[front_n[~is_leaf]]
            front_q, front_n = np.r_[front_q, front_q], np.r_[kids, kids + 1]
        lq, ln, lb = (np.concatenate(x) for x in zip(*leaves))
        order = np.lexsort((-lb, lq))
        lq, ln, lb = lq[order], ln[order], lb[order]
        turn = np.arange(len(lq)) - np.searchsorted(lq, lq)
        depth, wave = 0, 1
        while len(lq):
            now = turn < depth + wave
            q, n, b = lq[now], ln[now], lb[now]
            use = b >= best[q, -1]
            q, n = q[use], n[use]
            for node in np.unique(n):
                self._open(node, q[n == node], qids, queries, real, norm, best, bestid, k)
            lq, ln, lb, turn = lq[~now], ln[~now], lb[~now], turn[~now]
            depth, wave = depth + wave, wave * 2

    def _open(self, node, q, qids, queries, real, norm, best, bestid, k) -> None:
        pts, ids = self.points[self.lo[node]:self.hi[node]], self.ids[self.lo[node]:self.hi[node]]
        widest = norm[q].max(initial=0.0) * np.sqrt((pts.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0)
        if widest < 2**52:  # exact in doubles
            score = (real[q] @ pts.astype(np.float64).T).astype(np.int64)
        else:
            score = exact_scores(queries[q], pts)
        score = np.where(ids[None, :] == qids[q][:, None], _DEEP, score)
        both = np.concatenate([best[q], score], axis=1)
        who = np.concatenate([bestid[q], np.broadcast_to(ids, score.shape)], axis=1)
        pick = np.lexsort((who, -both.astype(np.float64) if widest < 2**52 else _descending(both)))[:, :k]
        best[q], bestid[q] = np.take_along_axis(both, pick, 1), np.take_along_axis(who, pick, 1)

    def to_bytes(self) -> dict:
        return {f: np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS}

    @classmethod
    def from_bytes(cls, row, dim: int) -> BallTree:
        kinds = {"points": np.int64, "ids": np.int64, "centre": np.float64, "radius": np.float64}
        a = {f: np.frombuffer(row[f], kinds.get(f, np.int64)) for f in cls.FIELDS}
        a["points"] = a["points"].reshape(len(a["ids"]), dim)
        a["centre"] = a["centre"].reshape(len(a["lo"]), dim)
        return cls(**a)


def _descending(x: np.ndarray) -> np.ndarray:
    """Order-reversing image of longs without overflow."""
    return ~x


def _trees(clean: DataFrame, shards: int, k: int, leaf: int) -> DataFrame:
    fields = ", ".join(f"{f} binary" for f in BallTree.FIELDS)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.array(pdf["q"].tolist(), np.int64).reshape(len(pdf), key[0])
        tree = BallTree.build(pdf["vec_id"].to_numpy(np.int64), points, k, leaf)
        return pd.DataFrame([{"dim": key[0], "shard": key[1]} | tree.to_bytes()])

    return (clean.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
            .groupBy("dim", "shard").applyInPandas(build, f"dim int, shard int, {fields}"))


def _wave(trees: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Search each block of queries in each of the given shards; the pairs
    are dealt out by an equality join on the vector length."""
    def search(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                tree = BallTree.from_bytes(row, row["dim"])
                qids = np.array([x["vec_id"] for x in row["queries"]], np.int64)
                qs = np.array([x["q"] for x in row["queries"]], np.int64).reshape(len(qids), row["dim"])
                floor = np.array([x["floor"] for x in row["queries"]], np.int64)
                best = np.repeat(floor[:, None], k, axis=1)  # the shared k-th score
                bestid = np.full((len(qids), k), np.iinfo(np.int64).max, np.int64)
                tree.search(qids, qs, best, bestid)
                hit = (bestid != np.iinfo(np.int64).max) & (best > _DEEP)
                yield pd.DataFrame({"query_id": np.broadcast_to(qids[:, None], best.shape)[hit],
                                    "vec_id": bestid[hit], "score": best[hit]})

    n = max(1, trees.sparkSession.sparkContext.defaultParallelism)
    pairs = trees.join(blocks, "dim").repartition(4 * n, "shard", "block")
    return pairs.mapInPandas(search, _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, top): each query's k best hits, combined before the shuffle
    by two-step grouping over salted halves."""
    def cut(pieces):
        return F.slice(F.array_sort(pieces), 1, k)

    hit = F.struct((-F.col("score")).alias("neg"), F.col("vec_id"))
    salted = hits.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("salt")).agg(
        cut(F.collect_list(hit)).alias("part"))
    return salted.groupBy("query_id").agg(cut(F.flatten(F.collect_list("part"))).alias("top"))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = 8192, block_rows: int = 1024, leaf: int = 64, first_wave: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best partners of every query.

    ``queries`` is a condition on the vectors' id that names the query rows.
    The vectors are dealt into shards of about ``shard_rows`` rows, the
    queries into blocks of about ``block_rows``; one shard in ``first_wave``
    is searched first.
    """
    clean = quantised(vectors, id_col, vec_col)
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    n_blocks = max(1, math.ceil(vectors.where(queries).count() / block_rows))
    trees = written(_trees(clean, shards, k, leaf), "trees")
    asked = (clean.where(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("v"))
             .select("vec_id", "v.dim", "v.q"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(n_blocks)).cast("int"))

    def blocks(frame: DataFrame) -> DataFrame:
        return frame.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "q", "floor")).alias("queries"))

    early = F.pmod(F.col("shard"), F.lit(first_wave)) == 0
    first = written(_best(_wave(trees.where(early), blocks(asked.withColumn("floor", F.lit(_DEEP))), k), k), "wave")
    floor = F.when(F.size("top") >= k, -F.element_at("top", k)["neg"]).otherwise(F.lit(_DEEP))
    known = asked.join(first.select(F.col("query_id").alias("vec_id"), floor.alias("f")), "vec_id", "left")
    later = _wave(trees.where(~early), blocks(known.withColumn("floor", F.coalesce("f", F.lit(_DEEP))).drop("f")), k)
    seen = first.select("query_id", F.inline("top")).select("query_id", "vec_id", (-F.col("neg")).alias("score"))
    return (_best(seen.unionByName(later), k).select("query_id", F.posexplode("top"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"),
                    (-F.col("col.neg")).alias("score")))
