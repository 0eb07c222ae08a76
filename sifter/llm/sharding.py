"""Sharding by extendible hashing.

A row's hash bits are read from the front.  The directory starts with one
bucket for all rows; a bucket whose rows exceed the byte limit, and only
such a bucket, splits on its next bit, until every bucket fits.  Buckets
therefore have different depths and a bucket's name is its bit prefix.

The directory comes from byte counts per fine cell (a prefix some bits
longer than needed on average): a cell's bucket is its shortest prefix whose
rows fit the limit, as bytes never grow with a longer prefix.  Cells that
still exceed the limit are counted again, alone, at more bits.

Rows with one hash (repeated ids) cannot be told apart by its bits.  If such
rows exceed the limit they are written out once and dealt into numbered
pages by a second hash, of their place in that table, by the same rule.  A
single row larger than the limit is a shard of its own, with ``fits`` false.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from sifter.llm.common import boxed, written

BITS = 60  # bits of an id's hash that are used, fifteen hex digits


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the md5 of a key, as a long (null: of '')."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    """The first ``depth`` of the 60 bits, as a number."""
    return F.shiftright(h, BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", h, F.lit(BITS) - depth)


def _directory(rows: DataFrame, limit: int, total: int) -> DataFrame:
    """(cell_depth, cell, depth, b, r): depth, bytes and rows of the bucket of
    every cell, for rows (h, n_bytes).  Depth null: all bits are used and the
    cell is over."""
    todo, low, out = rows, 0, None
    deep = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 6)
    while True:
        cells = (todo.withColumn("cell", _prefix(F.col("h"), deep)).groupBy("cell")
                 .agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")))
        cells = written(cells, "cells")
        every = F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth")
        up = cells.select("cell", "n_bytes", "n_rows", every)
        up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(deep) - F.col("depth")))
        fit = (up.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("b"), F.sum("n_rows").alias("r"))
               .where((F.col("b") <= limit) | (F.col("r") == 1)))
        placed = up.join(fit, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "b", "r")).alias("at"))
        got = cells.select("cell").join(placed, "cell", "left").select(F.lit(deep).alias("cell_depth"), "cell", "at.*")
        got = written(got, "directory")
        over = got.where(F.col("depth").isNull())
        if deep == BITS or over.isEmpty():
            return got if out is None else out.unionByName(got)
        settled = got.where(F.col("depth").isNotNull())
        out = settled if out is None else out.unionByName(settled)
        todo = todo.withColumn("cell", _prefix(F.col("h"), deep)).join(over.select("cell"), "cell", "left_semi").drop("cell")
        low, deep = deep + 1, min(BITS, deep + 8)


def _named(h: Column, depth: Column) -> Column:
    """The bucket's bit prefix as text ('' for the undivided table)."""
    return F.substring(F.lpad(F.bin(h), BITS, "0"), F.lit(1), depth)


def _assign(rows: DataFrame, directory: DataFrame, cols: list[str]) -> DataFrame:
    """Join each row to the cell that holds it, at any of the few cell depths."""
    depths = sorted(r[0] for r in directory.select("cell_depth").distinct().collect())
    out = None
    for d in depths or [0]:
        cells = directory.where(F.col("cell_depth") == d).select("cell", "depth", "b", "r")
        part = rows.withColumn("cell", _prefix(F.col("h"), d)).join(cells, "cell").select(*cols, "h", "n_bytes", "depth", "b", "r")
        out = part if out is None else out.unionByName(part)
    return out


def shard(docs: DataFrame, limit: int, *, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of every row with ``shard`` (bit prefix,
    then ``.page`` bits for rows that share all bits), ``shard_depth``,
    ``n_bytes`` (UTF-8 bytes of the text, null: 0), ``shard_bytes``,
    ``shard_rows`` and ``fits``.

    Every row is assigned; an empty table gives no row.  Columns of the input
    with one of these names are replaced.
    """
    made = ["shard", "shard_depth", "n_bytes", "shard_bytes", "shard_rows", "fits"]
    cols = [c for c in (keep or docs.columns) if c not in made]
    rows = boxed(docs, cols, h=hash_bits(F.col(id_col)), n_bytes=F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    sizes = rows.select("h", "n_bytes")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    directory = _directory(sizes, limit, total)
    placed = _assign(rows, directory, ["_row"])
    out = placed.where(F.col("depth").isNotNull()).select(
        "_row", "n_bytes", _named(F.col("h"), F.col("depth")).alias("shard"), F.col("depth").alias("shard_depth"), "b", "r")
    if not directory.where(F.col("depth").isNull()).isEmpty():
        out = out.unionByName(_pages(placed.where(F.col("depth").isNull()), limit))
    return out.select("_row.*", "shard", "shard_depth", "n_bytes", F.col("b").alias("shard_bytes"),
                      F.col("r").alias("shard_rows"), (F.col("b") <= limit).alias("fits"))


def _pages(full: DataFrame, limit: int) -> DataFrame:
    """Rows whose 60 bits are one oversized bucket: extendible hashing goes on
    with the bits of their place in the written table, bucket by bucket."""
    placed = written(full.select("_row", F.col("h").alias("key"), "n_bytes"), "pages")
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "places")
    rows = placed.withColumn("h", hash_bits(F.concat_ws(":", "key", "place")))
    sums = rows.groupBy("key").agg(F.sum("n_bytes").alias("b"))
    deep = min(BITS, max(1, math.ceil(math.log2(max(2, (sums.agg(F.max("b")).first()[0] or 1) / limit)))) + 6)
    done = None
    low, todo = 1, rows
    while True:
        cell = _prefix(F.col("h"), deep)
        cells = written(todo.groupBy("key", cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"),
                                                                     F.count("*").alias("n_rows")), "page-cells")
        up = cells.select("key", "cell", "n_bytes", "n_rows", F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth"))
        up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(deep) - F.col("depth")))
        fit = (up.groupBy("key", "depth", "prefix").agg(F.sum("n_bytes").alias("b"), F.sum("n_rows").alias("r"))
               .where((F.col("b") <= limit) | (F.col("r") == 1) | (F.col("depth") == BITS)))
        got = up.join(fit, ["key", "depth", "prefix"]).groupBy("key", "cell").agg(F.min(F.struct("depth", "b", "r")).alias("at"))
        got = got.select("key", "cell", "at.*")
        got = written(got, "page-directory")
        joined = todo.withColumn("cell", cell).join(got, ["key", "cell"], "left").drop("cell")
        part = joined.where(F.col("depth").isNotNull()).select(
            "_row", "n_bytes", F.concat(F.lpad(F.bin("key"), BITS, "0"), F.lit("."), _named(F.col("h"), F.col("depth"))).alias("shard"),
            (F.lit(BITS) + F.col("depth")).alias("shard_depth"), "b", "r")
        done = part if done is None else done.unionByName(part)
        todo = joined.where(F.col("depth").isNull()).drop("depth", "b", "r")
        if deep == BITS or todo.isEmpty():
            return done
        todo, low, deep = written(todo, "page-rows"), deep + 1, min(BITS, deep + 8)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
