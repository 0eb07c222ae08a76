"""Connected components of an edge table, by alternating large and small stars.

A round replaces each edge by one to the smallest neighbour, so paths shorten
by half; the rounds end when nothing changes.  Minima are grouped with
partial sums and joined back, so a node with a third of all edges is one row
per task before the shuffle.  Every round's edges are written to the shared
folder and the next one starts from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sifter.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where(F.col("v") < F.col("u"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:  # larger neighbours go to the smallest one
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours and the node itself do
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id reachable, for every id of the
    edges (u, v long).  Ids without an edge to another id are absent."""
    now = written(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
        seen = mark
        before, now = now, written(_star(_star(now, True), False), "edges")
        discard(before)
