"""Order-dependent helpers that never funnel rows through one task.

A window over the whole table (``row_number() OVER (ORDER BY k)``) moves
every row to a single task.  The helpers here range-partition on the order
key instead, work inside each partition, and stitch partitions together with
a table of per-partition totals whose size is bounded by the number of
partitions (plus the number of groups, when grouped).

* ``with_ordinal``   -- 0-based position in a total order (JVM only).
* ``running_total``  -- exclusive prefix sums of value columns in key order
  (the prefix inside a partition is a vectorised ``mapInPandas`` step).
* ``value_counts``   -- the count of each distinct value per group.
"""

from __future__ import annotations

import math
from typing import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.cache import persisted
from sifter.session import ship_package, shuffle_partitions

PID = "_sifter_pid"
LOCAL = "_sifter_local"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _range_sorted(df: DataFrame, keys: Sequence, num_partitions: int | None) -> DataFrame:
    n = num_partitions or shuffle_partitions(df.sparkSession)
    exprs = [_col(k) for k in keys]
    return df.repartitionByRange(n, *exprs).sortWithinPartitions(*exprs)


def _key_buckets(df: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """Add ``out``: the index of the key range (cut at ``percentile_approx``
    bounds, at most n ranges) holding each row.  Deterministic, so every
    branch of a plan that recomputes it agrees.

    Null keys sort first and NaN keys last.  Their rows are ties, so each kind
    is spread over n ranges of its own by a hash of the row."""
    from pyspark.ml.feature import Bucketizer
    kd = "_sifter_key"
    keyed = df.withColumn(kd, F.col(key).cast("double"))
    usable = F.when(~F.isnan(kd) & (F.abs(kd) < F.lit(math.inf)), F.col(kd))
    probs = [i / n for i in range(1, n)]
    bounds = keyed.agg(F.percentile_approx(usable, probs, max(10_000, 10 * n)).alias("b")).first()["b"] \
        if probs else []
    cuts = sorted({float(b) for b in (bounds or []) if b is not None})  # at most n - 1 values
    # no cuts: one distinct key (or none), a single range
    ranged = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=kd, outputCol=out,
                        handleInvalid="keep").transform(keyed) if cuts else keyed.withColumn(out, F.lit(0.0))
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields
                if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(n)).cast("double")
    return ranged.withColumn(out, F.when(F.col(kd).isNull(), spread - n)
                             .when(F.isnan(kd), spread + len(cuts) + 1)
                             .otherwise(F.col(out))).drop(kd)


def with_ordinal(df: DataFrame, order_by: Sequence, name: str = "record_index",
                 num_partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in ``order_by`` order.

    One numeric key: rows are cut into key ranges (``_key_buckets``), numbered
    with ``row_number`` inside each range, and offset by the row counts of
    the earlier ranges (a table of at most ``num_partitions`` rows, broadcast).
    Nothing is cached: the range of a row is a pure function of its key.

    Other keys: one range shuffle, rows numbered inside each partition, and
    per-partition counts as offsets; that frame is persisted so that the
    counts and the rows come from the same partitions.

    ``order_by`` should be unique; among ties any order is valid.
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    if len(order_by) == 1 and isinstance(order_by[0], str) \
            and isinstance(df.schema[order_by[0]].dataType, T.NumericType):
        key = order_by[0]
        bucketed = _key_buckets(df, key, n, PID)
        counts = bucketed.groupBy(PID).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(PID, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
        local = F.row_number().over(Window.partitionBy(PID).orderBy(key)) - 1
        return (bucketed.withColumn(LOCAL, local)
                .join(F.broadcast(offsets), PID)  # one row per key range
                .withColumn(name, (F.col("_off") + F.col(LOCAL)).cast("long"))
                .drop(PID, LOCAL, "_off"))
    ranged = (_range_sorted(df, order_by, num_partitions)
              .withColumn(PID, F.spark_partition_id())
              .withColumn(LOCAL, F.monotonically_increasing_id()
                          - F.shiftleft(F.col(PID).cast("long"), 33))
              .transform(persisted))
    counts = ranged.groupBy(PID).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(PID, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # offsets has one row per partition: a proven bound, so broadcast it.
    return (ranged.join(F.broadcast(offsets), PID)
            .withColumn(name, F.col("_off") + F.col(LOCAL))
            .drop(PID, LOCAL, "_off"))


def _local_prefix(value_cols: Sequence[str], group_cols: Sequence[str]):
    """Per-partition exclusive prefix sums, carried across Arrow batches."""

    def run(batches: Iterable[pd.DataFrame]):
        carry_key = None
        carry = {v: 0 for v in value_cols}
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{f"_loc_{v}": pdf[v] for v in value_cols})
                continue
            if group_cols:
                keys = pdf[list(group_cols)]
                change = keys.ne(keys.shift()).any(axis=1)
                change.iloc[0] = True
                seg = change.cumsum()
                first_key = tuple(keys.iloc[0])
                continues = carry_key is not None and first_key == carry_key
            else:
                seg = pd.Series(np.ones(len(pdf), dtype=np.int64), index=pdf.index)
                continues = carry_key is not None
            out = {}
            for v in value_cols:
                vals = pdf[v].fillna(0)
                incl = vals.groupby(seg.values).cumsum()
                if continues:
                    incl = incl + np.where(seg.values == seg.values[0], carry[v], 0)
                out[f"_loc_{v}"] = incl - vals
                carry[v] = incl.iloc[-1]
            carry_key = tuple(pdf[list(group_cols)].iloc[-1]) if group_cols else ()
            yield pdf.assign(**out)

    return run


def running_total(df: DataFrame, order_by: Sequence[str], value_cols: Sequence[str],
                  group_cols: Sequence[str] = (), prefix: str = "before_",
                  total_prefix: str | None = None,
                  num_partitions: int | None = None, method: str = "auto") -> DataFrame:
    """Add ``{prefix}{v}`` = sum of ``v`` over rows strictly earlier in
    ``(group_cols, order_by)`` order, restarting per group.

    ``order_by`` must be unique within a group (pre-aggregate first), and
    group keys must be non-null.  With ``total_prefix`` the group total of
    each value column is added too.

    ``method='buckets'`` (the default for one numeric order key, JVM only):
    the key is cut into ranges at ``percentile_approx`` bounds
    (``Bucketizer``, a binary search), a window running sum works inside
    each (group, range), and ranges are stitched by a table of range totals
    (at most #groups + #ranges rows).  ``method='partitions'`` (any order
    key): range-partition, a vectorised cumulative sum per partition in
    ``mapInPandas``, stitched by per-partition totals.
    """
    if method == "auto":
        numeric = len(order_by) == 1 and isinstance(df.schema[order_by[0]].dataType, T.NumericType)
        method = "buckets" if numeric else "partitions"
    if method == "buckets":
        return _running_total_buckets(df, order_by[0], value_cols, group_cols, prefix,
                                      total_prefix, num_partitions)
    return _running_total_partitions(df, order_by, value_cols, group_cols, prefix,
                                     total_prefix, num_partitions)


def _stitch(local: DataFrame, part: str, value_cols: Sequence[str], group_cols: Sequence[str],
            prefix: str, total_prefix: str | None) -> DataFrame:
    """Offsets of every part (partition or key range) from the part totals,
    joined back to the rows.  The totals table has at most #parts (+ #groups)
    rows: broadcast when ungrouped, left to AQE's size check otherwise."""
    totals = local.groupBy(part, *group_cols).agg(*[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    w = Window.partitionBy(*group_cols).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sel = [part, *group_cols]
    for v in value_cols:
        sel.append(F.coalesce(F.sum(f"_tot_{v}").over(w), F.lit(0)).alias(f"_off_{v}"))
        if total_prefix:
            sel.append(F.coalesce(F.sum(f"_tot_{v}").over(Window.partitionBy(*group_cols)),
                                  F.lit(0)).alias(f"{total_prefix}{v}"))
    offsets = totals.select(*sel)
    if not group_cols:
        offsets = F.broadcast(offsets)
    joined = local.join(offsets, [part, *group_cols])
    for v in value_cols:
        joined = joined.withColumn(f"{prefix}{v}", F.col(f"_off_{v}") + F.col(f"_loc_{v}"))
    return joined.drop(part, *[f"_loc_{v}" for v in value_cols], *[f"_off_{v}" for v in value_cols])


def _running_total_buckets(df: DataFrame, key: str, value_cols: Sequence[str],
                           group_cols: Sequence[str], prefix: str, total_prefix: str | None,
                           num_partitions: int | None) -> DataFrame:
    group_cols = list(group_cols)
    n = num_partitions or shuffle_partitions(df.sparkSession)
    bucketed = _key_buckets(df, key, n, PID)
    w = Window.partitionBy(*group_cols, PID).orderBy(key) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed
    for v in value_cols:
        local = local.withColumn(f"_loc_{v}", F.coalesce(F.sum(F.coalesce(F.col(v), F.lit(0)))
                                                         .over(w), F.lit(0)))
    return _stitch(local, PID, value_cols, group_cols, prefix, total_prefix)


def _running_total_partitions(df: DataFrame, order_by: Sequence[str], value_cols: Sequence[str],
                              group_cols: Sequence[str], prefix: str, total_prefix: str | None,
                              num_partitions: int | None) -> DataFrame:
    ship_package(df.sparkSession)  # the per-partition step runs in Python workers
    group_cols = list(group_cols)
    keys = group_cols + list(order_by)
    ranged = _range_sorted(df, keys, num_partitions).withColumn(PID, F.spark_partition_id())
    out_fields = list(ranged.schema.fields)
    for v in value_cols:
        dt = ranged.schema[v].dataType
        kind = T.LongType() if isinstance(dt, T.IntegralType) else T.DoubleType()
        out_fields.append(T.StructField(f"_loc_{v}", kind, True))
    local = (ranged.mapInPandas(_local_prefix(list(value_cols), group_cols), T.StructType(out_fields))
             .transform(persisted))
    return _stitch(local, PID, value_cols, group_cols, prefix, total_prefix)


def value_counts(df: DataFrame, value_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., ``_q_v``, ``_c``): the count of each distinct non-missing
    value per group.  Partial aggregation on every executor collapses hot
    values before the shuffle."""
    group_cols = list(group_cols)
    v = "_q_v"
    vals = (df.select(*group_cols, _nan_free(df, value_col).alias(v))
            .where(F.col(v).isNotNull()))
    return vals.groupBy(*group_cols, v).agg(F.count(F.lit(1)).alias("_c"))


def _nan_free(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    col = F.col(c).cast("double")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col), None).otherwise(col)
    return col
