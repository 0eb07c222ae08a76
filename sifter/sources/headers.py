"""Embedded header rows and header names."""

from __future__ import annotations

import functools
import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Words that speak for a header, rows searched, weight of a word.
HEADER_KEYWORDS = ("id", "date", "time", "name", "amount", "salary", "department")
HEADER_SEARCH_ROWS = 10
KEYWORD_WEIGHT = 3
#: more files than this are joined without a broadcast
_BROADCAST_FILES = 100_000
_FILE, _ROW, _BLOCK = "_sifter_file", "_sifter_row", "_sifter_block"


def clean_headers(names: Sequence) -> list[str]:
    """Trimmed; blank ones are ``column_{place}``; the n-th of equal names
    gets ``_{n}``, or the next number that is free."""
    named = [("" if n is None else str(n).strip()) or f"column_{i}" for i, n in enumerate(names, start=1)]
    out: list[str] = []
    for i, name in enumerate(named):
        tries = (name if k == 1 else f"{name}_{k}" for k in range(named[:i].count(name) + 1, len(named) + 2))
        out.append(next(t for t in tries if t not in out))
    return out


def header_score(fields: list[T.StructField]) -> Column:
    """How well a row serves as a header, null if it doesn't: at least two values,
    all of them texts that aren't blank and differ beyond case; one point each
    and three more for each that holds a keyword."""
    texts = [F.lower(F.trim(F.col(f"`{f.name}`"))) for f in fields if isinstance(f.dataType, T.StringType)]
    others = [F.col(f"`{f.name}`").isNotNull() for f in fields if not isinstance(f.dataType, T.StringType)]
    cells = F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")
    keyword = lambda v: functools.reduce(Column.__or__, [F.contains(v, F.lit(k)) for k in HEADER_KEYWORDS])
    fit = (F.size(cells) >= 2) & ~F.array_contains(cells, "") & (F.size(F.array_distinct(cells)) == F.size(cells))
    for present in others:
        fit = fit & ~present
    return F.when(fit, F.size(cells) + KEYWORD_WEIGHT * F.size(F.filter(cells, keyword)))


def _placeholder(name: str) -> bool:
    return re.fullmatch(r"Unnamed:.*|_c\d+", str(name), re.DOTALL) is not None


def promote_header_row(df: DataFrame, order: str | None = None) -> DataFrame:
    """B2: where every column name is a placeholder, the best header among the
    first ten rows of each file names the columns, and it and the rows above it
    go.  The first of equally good rows wins.  Files are united by column name; a
    file without such a row keeps its rows under the placeholders.

    Rows that come from files know their file and whether they lie in its first
    split, so two narrow passes find each file's first row and then its first ten;
    a table from elsewhere is one file.  ``order`` names a column to order by
    instead; the table is then one file, too.
    """
    if not df.columns or not all(_placeholder(c) for c in df.columns if c != order):
        return df
    fields = [f for f in df.schema.fields if f.name != order]
    if order:
        base = df.select("*", F.lit("").alias(_FILE), F.col(f"`{order}`").alias(_ROW), F.lit(0).alias(_BLOCK))
    else:
        base = df.select("*", F.input_file_name().alias(_FILE), F.monotonically_increasing_id().alias(_ROW), F.input_file_block_start().alias(_BLOCK))
    start = base.where(F.col(_BLOCK) <= 0)
    first = start.groupBy(_FILE).agg(F.min(_ROW).alias("first"))
    files = first.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col(_FILE)), F.lit("")).alias("last")).first()
    if files["last"]:
        n_files = files["n"]
        head = start.join(_small(first, n_files), _FILE).where(F.col(_ROW) < F.col("first") + HEADER_SEARCH_ROWS)
    else:  # no files: the ten smallest of any sortable column
        head, n_files = start.orderBy(_ROW).limit(HEADER_SEARCH_ROWS), 1
    cells = F.array(*[F.col(f"`{f.name}`").cast("string") for f in fields])
    found = head.select(_FILE, _ROW, cells.alias("cells"), header_score(fields).alias("score")).where("score is not null")
    best = found.groupBy(_FILE).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(_ROW).alias("row"), "cells")).alias("b"))
    best = best.select(_FILE, F.col("b.row").alias("header_row"), F.col("b.cells").alias("header"), F.to_json("b.cells").alias("kind"))
    kinds = best.groupBy("kind").agg(F.min(_FILE).alias("f"), F.first("header").alias("header"), F.count("*").alias("n")).orderBy("f").collect()
    if not kinds:  # one row per kind of header
        return df
    body = base.join(_small(best.drop("header"), n_files), _FILE, "left")
    body = body.where(F.col("header_row").isNull() | (F.col(_BLOCK) > 0) | (F.col(_ROW) > F.col("header_row")))
    keep = [F.col(f"`{order}`")] if order else []

    def named(rows: DataFrame, names: list[str]) -> DataFrame:
        return rows.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names)], *keep)

    parts = [named(body.where(F.col("kind") == k["kind"]), clean_headers(k["header"])) for k in kinds]
    if sum(k["n"] for k in kinds) < n_files:  # some file has no header row
        parts.append(named(body.where("kind is null"), [f.name for f in fields]))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _small(per_file: DataFrame, n_files: int) -> DataFrame:
    """A table of one row per file, broadcast if there are not too many files."""
    return F.broadcast(per_file) if n_files <= _BROADCAST_FILES else per_file
