"""Chart-ready aggregates.

Each function returns the data behind a chart, not an image: counts per
category, grouped means, histogram bins with edges, box statistics, daily
means, scatter pairs.  Statistics that a later step applies to every row
(histogram range, box fences) are bounded one-row (or one-row-per-group)
results.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.cols import missing, safe_double, try_timestamp, truncate_label
from sifter.functions.order import with_ordinal
from sifter.functions.quantile import quantiles

BINS = 10
MAX_VISIBLE_TICKS = 12


def _num(df: DataFrame, c: str):
    return safe_double(F.col(f"`{c}`"), df.schema[c].dataType)


def category_counts(af: DataFrame, compare: str) -> DataFrame:
    """Non-missing values as text, their count, sorted by value."""
    c = F.col(f"`{compare}`")
    return (af.where(~missing(c, af.schema[compare].dataType))
            .groupBy(c.cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("value"))


def grouped_mean(af: DataFrame, target: str, compare: str) -> DataFrame:
    """Mean of the target per compare value; rows missing either side
    are dropped; sorted by key."""
    t, c = _num(af, target), F.col(f"`{compare}`")
    return (af.where(t.isNotNull() & ~missing(c, af.schema[compare].dataType))
            .groupBy(c.alias("key")).agg(F.avg(t).alias("mean"))
            .orderBy("key"))


def histogram(af: DataFrame, target: str, bins: int = BINS) -> DataFrame:
    """``bins`` equal-width bins over [min, max] of the non-missing
    target; last bin closed; a constant series uses [x-0.5, x+0.5].
    Every bin is returned (zero counts included) with its edges."""
    t = _num(af, target)
    lo_hi = af.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    spark = af.sparkSession
    lo, hi = lo_hi["lo"], lo_hi["hi"]
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    idx = F.least(F.floor((t - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)),
                  F.lit(bins - 1)).cast("int")
    counts = af.where(t.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (frame.join(F.broadcast(counts), "bin", "left")  # at most ``bins`` rows
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    F.when(F.col("bin") == bins - 1, F.lit(hi))
                     .otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .orderBy("bin"))


def _whiskers(v, q1, q3, lo_fence, hi_fence):
    """Furthest datum inside the fences, never inside the box."""
    return (F.least(F.coalesce(F.min(F.when(v >= lo_fence, v)), q1), q1).alias("whisker_low"),
            F.greatest(F.coalesce(F.max(F.when(v <= hi_fence, v)), q3), q3).alias("whisker_high"))


def _box_grouped(values: DataFrame, group_cols: Sequence[str], accuracy: str) -> DataFrame:
    """Box statistics of column ``v`` per group.  The quantile table has one
    row per group; it is joined back to the values (AQE broadcasts it when
    its runtime size allows).  No datum lies between a fence and its whisker, so
    the pass that finds the whiskers counts the outliers too."""
    q = quantiles(values, "v", [0.25, 0.5, 0.75], group_cols, names=["q1", "median", "q3"],
                  accuracy=accuracy)
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = values.join(q, list(group_cols))
    v, lo, hi = F.col("v"), F.col("lo_fence"), F.col("hi_fence")
    wl, wh = _whiskers(v, F.first("q1"), F.first("q3"), lo, hi)
    return j.groupBy(*group_cols).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), wl, wh, F.count_if((v < lo) | (v > hi)).alias("outliers"))


BOX_SCHEMA = ("n long, q1 double, median double, q3 double, whisker_low double, "
              "whisker_high double, outliers long")


def box_stats(af: DataFrame, target: str, accuracy: str = "exact") -> DataFrame:
    """N, q1, median, q3, whiskers and the number of outliers.

    The quartiles are a bounded one-row result; they enter the whisker and
    outlier pass as literals."""
    vals = af.select(_num(af, target).alias("v")).where(F.col("v").isNotNull())
    q = quantiles(vals, "v", [0.25, 0.5, 0.75], [], names=["q1", "median", "q3"],
                  accuracy=accuracy).first()
    spark = af.sparkSession
    if q is None or not q["n"]:
        return spark.createDataFrame([], BOX_SCHEMA)
    q1, q3 = q["q1"], q["q3"]
    lo_f, hi_f = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    v = F.col("v")
    wl, wh = _whiskers(v, F.lit(q1), F.lit(q3), F.lit(lo_f), F.lit(hi_f))
    w = vals.agg(wl, wh, F.count_if((v < lo_f) | (v > hi_f)).alias("outliers")).first()  # none lies between fence and whisker
    return spark.createDataFrame(
        [(q["n"], q1, q["median"], q3, w["whisker_low"], w["whisker_high"], w["outliers"])], BOX_SCHEMA)


def box_outliers(af: DataFrame, target: str, box: DataFrame) -> DataFrame:
    """E12 fliers: the rows whose target lies outside the whiskers (the
    whiskers are one row, applied as literals)."""
    b = box.first()
    v = _num(af, target)
    if b is None:
        return af.limit(0)
    return af.where(v.isNotNull() & ((v < b["whisker_low"]) | (v > b["whisker_high"])))


def grouped_box_stats(af: DataFrame, target: str, compare: str,
                      accuracy: str = "exact") -> DataFrame:
    """Box statistics of the numeric-coerced target per compare group,
    plus the outlier count per group (groups without a numeric value are
    absent; ``pipeline.chart_data`` raises when none is left)."""
    c = F.col(f"`{compare}`")
    vals = (af.where(~missing(c, af.schema[compare].dataType))
            .select(c.alias("key"), _num(af, target).alias("v"))
            .where(F.col("v").isNotNull()))
    return _box_grouped(vals, ["key"], accuracy).orderBy("key")


def grouped_box_sweep(af: DataFrame, target: str, compares: Sequence[str], accuracy: str = "exact") -> DataFrame:
    """E13 for several compare variables together: (variable, key as text, box
    statistics).  A row is read once and stands under each of its variables,
    so all groups of all variables share every scan for their quartiles."""
    def key(c: str):
        return F.when(~missing(F.col(f"`{c}`"), af.schema[c].dataType), F.col(f"`{c}`").cast("string"))

    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), key(c).alias("key")) for c in compares])
    rows = af.select(_num(af, target).alias("v"), F.inline(pairs)).where(F.col("v").isNotNull() & F.col("key").isNotNull())
    return _box_grouped(rows, ["variable", "key"], accuracy)


def daily_mean(af: DataFrame, target: str, date_field: str) -> DataFrame:
    """Numeric target, parsed date, mean per calendar day (days without
    data absent), ascending.  A DECIMAL target is averaged exactly, so the
    result does not depend on how rows are spread over partitions."""
    t = F.col(f"`{target}`") if isinstance(af.schema[target].dataType, T.DecimalType) \
        else _num(af, target)
    d = try_timestamp(F.col(f"`{date_field}`"), af.schema[date_field].dataType)
    return (af.select(t.alias("t"), F.to_date(d).alias("day"))
            .where(F.col("t").isNotNull() & F.col("day").isNotNull())
            .groupBy("day").agg(F.avg("t").alias("mean"))
            .orderBy("day"))


# ---------------------------------------------------------------- B21, B22

def label_encode(df: DataFrame, col: str, order: str = "record_index",
                 name: str | None = None, fill: str = "Missing") -> DataFrame:
    """Codes 0.. in order of first appearance (after null -> ``fill``).

    First appearances are a grouped ``min`` (one row per distinct value);
    codes are ordinals over that table, joined back on the value."""
    name = name or f"{col}_code"
    text = F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(fill))
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        text = F.when(F.isnan(F.col(f"`{col}`")), F.lit(fill)).otherwise(text)
    keyed = df.withColumn("_lbl", text)
    firsts = keyed.groupBy("_lbl").agg(F.min(order).alias("_first"))
    codes = with_ordinal(firsts, ["_first"], name="_code").select("_lbl", "_code")
    return keyed.join(codes, "_lbl").withColumnRenamed("_code", name).drop("_lbl")


def _is_axis_native(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def scatter_pairs(df: DataFrame, x: str, y: str, order: str = "record_index",
                  dates: Sequence[str] = ()) -> DataFrame:
    """(x, y) pairs with a missing side dropped.  An axis that is
    neither numeric nor a date is label-encoded by first appearance."""
    cur = df
    axes = {}
    for side, c in (("x", x), ("y", y)):
        dt = cur.schema[c].dataType
        if c in dates:
            axes[side] = try_timestamp(F.col(f"`{c}`"), dt)
        elif _is_axis_native(dt):
            axes[side] = F.col(f"`{c}`").cast("double") if isinstance(dt, T.NumericType) \
                else F.col(f"`{c}`")
        else:
            cur = label_encode(cur, c, order, name=f"_{side}_code")
            axes[side] = F.col(f"_{side}_code")
    out = cur.select(F.col(order), axes["x"].alias("x"), axes["y"].alias("y"))
    cond = F.col("x").isNotNull() & F.col("y").isNotNull()
    for s in ("x", "y"):
        if isinstance(out.schema[s].dataType, T.DoubleType):
            cond = cond & ~F.isnan(s)
    return out.where(cond)


# ---------------------------------------------------------------- G6, E15

def thinned_labels(labels: DataFrame, label: str, order: Sequence[str],
                   max_ticks: int = MAX_VISIBLE_TICKS) -> DataFrame:
    """Which of n ordered labels stay visible: every ``max(1, n div
    max_ticks)``-th plus the last; long labels truncated to 18 chars."""
    ordered = with_ordinal(labels, list(order), name="position")
    n = labels.count()
    step = max(1, n // max_ticks) if n > max_ticks else 1
    vis = (F.col("position") % step == 0) | (F.col("position") == n - 1) \
        if n > max_ticks else F.lit(True)
    return ordered.select("position", F.col(label).alias("label"),
                          truncate_label(F.col(label)).alias("short_label"),
                          vis.alias("visible"))


def relationship_sweep(af: DataFrame, target: str, compares: Sequence[str],
                       date_field: str = "Order Date", order: str = "record_index",
                       accuracy: str = "exact") -> dict[str, DataFrame]:
    """Scatter and grouped box per compare variable (plus the daily line
    for the date field), tagged with the variable; one table per kind."""
    have = [c for c in compares if c in af.columns]
    # y is a number, a label code or a date: carried as text so the
    # variables can share one table
    scat = [scatter_pairs(af, target, c, order, dates=[date_field]).select(F.lit(c).alias("variable"), "x", F.col("y").cast("string").alias("y"))
            for c in have]
    lines = [daily_mean(af, target, c).select(F.lit(c).alias("variable"), "day", "mean") for c in have if c == date_field]
    grouped = [c for c in have if c != date_field]
    boxes = [grouped_box_sweep(af, target, grouped, accuracy)] if grouped else []

    def union(parts):
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    return {"scatter": union(scat), "grouped_box": union(boxes), "daily_line": union(lines)}
