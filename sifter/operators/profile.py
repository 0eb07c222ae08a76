"""Dataset profile.

Works on an *analysis frame*: the flat records projected to the resolved
analysis fields and named by label (``reshape.analysis_frame``).  Each
summary is one aggregation over a long ``(field, value)`` view, so adding a
field adds rows to a shuffle-free ``stack`` rather than another scan.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.cache import persisted
from sifter.functions.cols import missing, norm_field_expr, safe_double
from sifter.functions.quantile import column_quantiles
from sifter.operators.reshape import (
    CATEGORY_FIELDS, DATE_FIELDS, NUMERIC_FIELDS, TARGET_FIELD, analysis_frame,
    chart_context, resolve_fields,
)

DIGITS = 4


def _present(af: DataFrame, labels: Sequence[str]) -> list[str]:
    return [l for l in labels if l in af.columns]


def _long(af: DataFrame, labels: Sequence[str], value) -> DataFrame:
    """(field, value) rows, one per input row and label; nulls kept."""
    parts = []
    for l in labels:
        parts += [F.lit(l), value(l)]
    return af.select(F.inline(F.array(*[F.struct(parts[i].alias("field"),
                                                 parts[i + 1].alias("value"))
                                        for i in range(0, len(parts), 2)])))


def numeric_summary(af: DataFrame, fields: Sequence[str] = NUMERIC_FIELDS,
                    accuracy: str = "exact") -> DataFrame:
    """Per numeric field: count, missing, min, max, mean, median and the
    sample standard deviation (null when n <= 1), rounded to 4 digits."""
    labels = _present(af, fields)
    if not labels:
        return af.sparkSession.createDataFrame([], "field string, count long, missing long, "
                                               "min double, max double, mean double, "
                                               "median double, std double")
    cols = {l: safe_double(F.col(f"`{l}`"), af.schema[l].dataType) for l in labels}
    aggs = []
    for i, v in enumerate(cols.values()):
        aggs += [F.count(v).alias(f"n{i}"), F.count(F.lit(1)).alias(f"r{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
        if accuracy != "exact":
            aggs.append(F.percentile_approx(v, 0.5, 10_000).alias(f"q{i}"))
    one = af.agg(*aggs).first()
    median = ({l: q[0] for l, (_, q) in column_quantiles(af, cols, [0.5]).items()} if accuracy == "exact"
              else {l: one[f"q{i}"] for i, l in enumerate(labels)})
    rows = [(l, one[f"n{i}"], one[f"r{i}"] - one[f"n{i}"], one[f"lo{i}"], one[f"hi{i}"], one[f"m{i}"], median.get(l), one[f"s{i}"])
            for i, l in enumerate(labels) if one[f"r{i}"]]
    out = af.sparkSession.createDataFrame(rows, "field string, count long, missing long, min double, max double, mean double, median double, std double")
    return out.select("field", "count", "missing",
                      *[F.round(c, DIGITS).alias(c) for c in ("min", "max", "mean", "median")],
                      F.round(F.when(F.col("count") > 1, F.col("std")), DIGITS).alias("std"))


def date_summary(af: DataFrame, fields: Sequence[str] = DATE_FIELDS) -> DataFrame:
    """Count of parsable dates, missing (null or unparsable) and the
    min / max calendar date as ``yyyy-MM-dd``."""
    labels = _present(af, fields)
    rows = []
    for l in labels:
        ts = F.col(f"`{l}`").cast("timestamp")
        rows.append(af.agg(
            F.lit(l).alias("field"), F.count(ts).alias("count"),
            (F.count(F.lit(1)) - F.count(ts)).alias("missing"),
            F.date_format(F.min(ts), "yyyy-MM-dd").alias("min_date"),
            F.date_format(F.max(ts), "yyyy-MM-dd").alias("max_date")))
    if not rows:
        return af.sparkSession.createDataFrame(
            [], "field string, count long, missing long, min_date string, max_date string")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _as_text(af: DataFrame, l: str):
    c = F.col(f"`{l}`")
    return F.when(~missing(c, af.schema[l].dataType), c.cast("string"))


def categorical_summary(af: DataFrame, fields: Sequence[str] = CATEGORY_FIELDS) -> DataFrame:
    """Count, missing and distinct count per categorical field."""
    labels = _present(af, fields)
    if not labels:
        return af.sparkSession.createDataFrame(
            [], "field string, count long, missing long, unique long")
    long = _long(af, labels, lambda l: _as_text(af, l))
    v = F.col("value")
    return long.groupBy("field").agg(
        F.count(v).alias("count"), (F.count(F.lit(1)) - F.count(v)).alias("missing"),
        F.count_distinct(v).alias("unique"))


def top_values(af: DataFrame, fields: Sequence[str] = CATEGORY_FIELDS, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per field, ties by value."""
    labels = _present(af, fields)
    out = None
    for l in labels:
        t = (af.select(_as_text(af, l).alias("value")).where(F.col("value").isNotNull())
             .groupBy("value").agg(F.count(F.lit(1)).alias("count"))
             .orderBy(F.desc("count"), F.asc("value")).limit(k)
             .select(F.lit(l).alias("field"), "value", "count"))
        out = t if out is None else out.unionByName(t)
    if out is None:
        return af.sparkSession.createDataFrame([], "field string, value string, count long")
    return out


#: values tracked by the sketch of ``heavy_values``, try by try
TRACKED = (4_096, 32_768, 262_144)


def heavy_values(rows: DataFrame, value: str, k: int = 10, tracked: Sequence[int] = TRACKED) -> DataFrame:
    """G1 for columns of very many values: (value, count) of the ``k`` most
    frequent present values, ties by value, exact, without shuffling every value.

    A frequent-items sketch of fixed size names candidates: with n rows and m
    tracked values it surely holds every value that occurs more than 7 n / m
    times.  The candidates are counted exactly in a second scan.  The result
    stands if no value is left over or the k-th count lies above that bound;
    otherwise a larger sketch is tried, and at last all values are counted.
    """
    c = F.col(f"`{value}`")
    present = rows.select(F.when(~missing(c, rows.schema[value].dataType), c).alias("value")).where(F.col("value").isNotNull())
    most = (F.desc("count"), F.asc("value"))
    for m in tracked:
        found = present.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(value, {min(m, 100_000)}, {m})").alias("top")).first()
        if not found["n"]:
            break
        listed = rows.sparkSession.createDataFrame([(t["item"],) for t in found["top"] or ()], present.schema)
        exact = present.join(F.broadcast(listed), "value").groupBy("value").agg(F.count("*").alias("count"))  # at most m values
        seen = exact.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("values")).first()
        best = exact.orderBy(*most).limit(k)
        if seen["n"] == found["n"] or (seen["values"] >= k and best.agg(F.min("count")).first()[0] > 7 * found["n"] / m):
            return best.orderBy(*most)
    return present.groupBy("value").agg(F.count("*").alias("count")).orderBy(*most).limit(k)


def missing_by_field(af: DataFrame) -> DataFrame:
    """Missing count per resolved analysis field (unparsable dates count)."""
    return missing_by_column(af)


def missing_by_column(flat: DataFrame) -> DataFrame:
    """E5: missing (null or NaN) count for every column, one row per column."""
    if not flat.columns:
        return flat.sparkSession.createDataFrame([], "column string, missing long")
    aggs = [F.count_if(missing(F.col(f"`{f.name}`"), f.dataType)).alias(f"c{i}")
            for i, f in enumerate(flat.schema.fields)]
    wide = flat.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}").alias("missing"))
                      for i, f in enumerate(flat.schema.fields)])
    return wide.select(F.inline(pairs))


def shape(flat: DataFrame) -> DataFrame:
    """Rows, columns and number of resolved analysis fields."""
    n_fields = len(resolve_fields(flat.columns))
    return flat.agg(F.count(F.lit(1)).alias("rows")) \
               .select("rows", F.lit(len(flat.columns)).alias("columns"),
                       F.lit(n_fields).alias("variables"))


def target_stats(af: DataFrame, target: str = TARGET_FIELD) -> DataFrame:
    """Min, max, mean and count of the target field."""
    if target not in af.columns:
        return af.sparkSession.createDataFrame(
            [], "min double, max double, mean double, count long")
    v = safe_double(F.col(f"`{target}`"), af.schema[target].dataType)
    return af.agg(F.round(F.min(v), DIGITS).alias("min"), F.round(F.max(v), DIGITS).alias("max"),
                  F.round(F.avg(v), DIGITS).alias("mean"), F.count(v).alias("count"))


def overview(flat: DataFrame, accuracy: str = "exact") -> dict:
    """The composite dataset overview as a dict of small DataFrames.

    The analysis frame is persisted once and shared by every summary.
    ``overview_document`` is the same as one nested row, without persisting."""
    af = analysis_frame(flat).transform(persisted)
    resolved = resolve_fields(flat.columns)
    return {
        "fields": list(resolved.keys()),
        "shape": shape(flat),
        "missing_by_column": missing_by_field(af),
        "numeric_summary": numeric_summary(af, accuracy=accuracy),
        "date_summary": date_summary(af),
        "categorical_summary": categorical_summary(af),
        "top_values": top_values(af),
        "target_stats": target_stats(af),
        "chart_context": chart_context(flat.columns),
        "compare_options": [l for l in resolved if l != TARGET_FIELD],
    }


DOCUMENT = """rows long, columns int, fields array<string>, compare_options array<string>,
numeric array<struct<field:string,count:long,missing:long,min:double,max:double,mean:double,median:double,std:double>>,
dates array<struct<field:string,count:long,missing:long,min_date:string,max_date:string>>,
categories array<struct<field:string,count:long,missing:long,unique:long,top:array<struct<value:string,count:long>>>>,
charts map<string,map<string,string>>, source map<string,string>"""


def _rounded(x: float | None) -> float | None:
    """To 4 digits, halves away from zero, as Spark rounds."""
    return None if x is None else float(Decimal(repr(x)).quantize(Decimal(10) ** -DIGITS, ROUND_HALF_UP)) if math.isfinite(x) else x


def overview_document(flat: DataFrame, source: dict | None = None, k: int = 10) -> DataFrame:
    """The whole overview as one nested row, to show or to export
    (``store.export_document``); ``source`` is the data set's description (A14).

    One aggregate yields the counts, extremes and moments of all fields and one
    count per distinct value those of all categorical fields together; medians
    come from the shared brackets of ``column_quantiles``.  Only these bounded
    results reach the driver: per categorical field its counts and ``k`` values.
    """
    spark, af = flat.sparkSession, analysis_frame(flat)
    numeric = {l: safe_double(F.col(f"`{l}`"), af.schema[l].dataType) for l in _present(af, NUMERIC_FIELDS)}
    dates = {l: F.col(f"`{l}`").cast("timestamp") for l in _present(af, DATE_FIELDS)}
    texts = _present(af, CATEGORY_FIELDS)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(numeric.values()):
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    for i, v in enumerate(dates.values()):
        aggs += [F.count(v).alias(f"dn{i}"), F.date_format(F.min(v), "yyyy-MM-dd").alias(f"dlo{i}"), F.date_format(F.max(v), "yyyy-MM-dd").alias(f"dhi{i}")]
    one = af.agg(*aggs).first()
    rows = one["rows"]
    median = {l: q[0] for l, (_, q) in column_quantiles(af, numeric, [0.5]).items()} if rows and numeric else {}
    numbers = [(l, one[f"n{i}"], rows - one[f"n{i}"], *map(_rounded, (one[f"lo{i}"], one[f"hi{i}"], one[f"m{i}"], median.get(l), one[f"s{i}"])))
               for i, l in enumerate(numeric)]
    days = [(l, one[f"dn{i}"], rows - one[f"dn{i}"], one[f"dlo{i}"], one[f"dhi{i}"]) for i, l in enumerate(dates)]
    categories = []
    if texts:
        counted = _long(af, texts, lambda l: _as_text(af, l)).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
        totals = counted.groupBy("field").agg(F.sum("n").alias("n"), F.count("*").alias("u"))
        found = {r["field"]: (r["n"], r["u"]) for r in totals.collect()}
        top = {l: [(r["value"], r["n"]) for r in counted.where(F.col("field") == l).orderBy(F.desc("n"), "value").limit(k).collect()] for l in texts}
        categories = [(l, found.get(l, (0, 0))[0], rows - found.get(l, (0, 0))[0], found.get(l, (0, 0))[1], top[l]) for l in texts]
    have = list(resolve_fields(flat.columns))
    context = {chart: {v: l for v, l in roles.items() if l} for chart, roles in chart_context(flat.columns).items()}
    source = {key: str(value) for key, value in (source or {}).items() if value is not None}
    document = (rows, len(flat.columns), have, [l for l in have if l != TARGET_FIELD], numbers, days, categories, context, source)
    return spark.createDataFrame([document], DOCUMENT)


def filter_fields(summary: DataFrame, selected, field_col: str = "field") -> DataFrame:
    """Keep the summary rows of the chosen fields, names compared after
    trimming, lower-casing, ``_`` -> space and collapsing whitespace."""
    import re as _re
    keys = sorted({_re.sub(r"\s+", " ", str(s).strip().lower().replace("_", " ")) for s in selected})
    return summary.where(norm_field_expr(F.col(field_col)).isin(keys))


def with_missing(summary: DataFrame, missing_col: str = "missing") -> DataFrame:
    """Summary rows of fields that have missing values."""
    return summary.where(F.col(missing_col) > 0)
