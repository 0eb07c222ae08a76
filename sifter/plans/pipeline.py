"""Compositions a user calls (K1-K6) and the cleaning audit.

The pipeline is one lazy plan from source to stored records: the one write
scans the source and counts what it validates on the way (``Observation``), and
the scores read the store back.  Intelligence steps run best effort: their
failure is logged, not fatal.
"""

from __future__ import annotations

import functools
import logging
import time
from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sifter.functions.cols import missing
from sifter.operators import anomaly, charts, forecast, reshape, validate
from sifter.sources import readers, routing, store

log = logging.getLogger("sifter.pipeline")


# ---------------------------------------------------------------- E22, D2

def duplicate_count(canon: DataFrame, keys: Sequence[str] = ("entity_id", "timestamp")) -> DataFrame:
    """Number of rows after the first of each repeated key (keys with a
    missing part skipped) = rows with a full key - distinct full keys.
    Needs no row order; one map-side-combined aggregation."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & ~missing(F.col(k), canon.schema[k].dataType)
    per_key = canon.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def _tidy(metric: str, frame: DataFrame, field_col, value_col, side: str) -> DataFrame:
    return frame.select(F.lit(metric).alias("metric"), field_col.alias("field"),
                        value_col.cast("long").alias(side))


def audit_measures(canon: DataFrame, side: str) -> DataFrame:
    """One side of the audit as tidy rows ``(metric, field, <side>)``.

    Row count, missing count per flat column, valid and invalid rows and the
    count of every validation message come from ONE aggregation over the
    validated records (each message is a fixed text, so its count is a
    ``count_if``); duplicates need their own grouped aggregation.  Reasons
    that do not occur are left out."""
    flat_fields = reshape.flatten(canon).schema.fields
    checked = validate.validate(canon)
    feature_cols = {f.name: F.col("features").getField(f.name)
                    for f in canon.schema["features"].dataType.fields}
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("status") == "invalid").alias("invalid_rows"),
            F.count_if(F.col("status") == "valid").alias("valid_rows")]
    for i, f in enumerate(flat_fields):
        c = feature_cols.get(f.name, F.col(f.name))
        aggs.append(F.count_if(missing(c, f.dataType)).alias(f"m{i}"))
    for i, msg in enumerate(validate.RECORD_ERRORS):
        aggs.append(F.count_if(F.array_contains("errors", msg)).alias(f"r{i}"))
    wide = checked.agg(*aggs)
    entries = [("rows", "", "rows"), ("invalid_rows", "", "invalid_rows"),
               ("valid_rows", "", "valid_rows")]
    entries += [("missing", f.name, f"m{i}") for i, f in enumerate(flat_fields)]
    entries += [("invalid_reason", msg, f"r{i}") for i, msg in enumerate(validate.RECORD_ERRORS)]
    tidy = wide.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(fl).alias("field"),
                 F.col(c).cast("long").alias(side)) for m, fl, c in entries])))
    tidy = tidy.where((F.col("metric") != "invalid_reason") | (F.col(side) > 0))
    dups = _tidy("duplicates", duplicate_count(canon), F.lit(""), F.col("duplicates"), side)
    return tidy.unionByName(dups)


def cleaning_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """before/after comparison as tidy rows ``(metric, field, before,
    after)``: row counts, missing per flat column, duplicates, invalid rows,
    invalid reasons and valid rows, each measured on both sides (a field or
    reason absent on one side counts 0).  Each side reduces to a few rows
    before the full outer join on (metric, field) (D2)."""
    b = audit_measures(before, "before")
    a = audit_measures(after, "after")
    return b.join(a, ["metric", "field"], "full") \
            .select("metric", "field", F.coalesce("before", F.lit(0)).cast("long").alias("before"),
                    F.coalesce("after", F.lit(0)).cast("long").alias("after")) \
            .orderBy("metric", "field")


def standard_cleaning_audit(canon: DataFrame, order: str, keys: Sequence[str] = ("entity_id", "timestamp")) -> DataFrame:
    """E22 for the standard cleaning (invalid records go, then all but the first
    by ``order`` of each key): the rows of ``cleaning_audit`` from one scan.

    A key's valid records shrink to one, so one aggregation per key knows both
    sides: counts over all its records, and the marks of its first valid one.
    Records whose key is incomplete are invalid.  A hot key is combined on the
    map side.
    """
    checked = validate.validate(canon)
    flat = {f.name: (F.col(f"features.`{f.name}`"), f.dataType) for f in canon.schema["features"].dataType.fields}
    flat = {k: (F.col(k), canon.schema[k].dataType) for k in ("entity_id", "timestamp")} | flat
    good = F.col("status") == "valid"
    marks = {("rows", ""): F.lit(True), ("invalid_rows", ""): ~good, ("valid_rows", ""): good}
    marks |= {("missing", name): missing(c, t) for name, (c, t) in flat.items()}
    marks |= {("invalid_reason", msg): F.array_contains("errors", msg) for msg in validate.RECORD_ERRORS}
    names = [f"m{i}" for i in range(len(marks))]
    rows = checked.select(*keys, F.col(order).alias("_order"), good.alias("_good"), *[F.coalesce(m, F.lit(False)).alias(n) for n, m in zip(names, marks.values())])
    first = F.min_by(F.struct(*names), F.when(F.col("_good"), F.col("_order")))
    whole = functools.reduce(Column.__and__, [~missing(F.col(k), canon.schema[k].dataType) for k in keys])
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("_good").alias("_good"), first.alias("first"), *[F.count_if(n).alias(f"b_{n}") for n in names])
    sides = per_key.agg(
        F.sum(F.when(whole, F.col("n") - 1).otherwise(0)).alias("copies"),
        *[F.sum(f"b_{n}").alias(f"b_{n}") for n in names],
        *[F.count_if(F.col("_good") & F.col(f"first.{n}")).alias(f"a_{n}") for n in names])
    entries = [(metric, fld, F.col(f"b_{n}"), F.col(f"a_{n}")) for n, (metric, fld) in zip(names, marks)]
    entries.append(("duplicates", "", F.col("copies"), F.lit(0)))
    tidy = sides.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(f).alias("field"), F.coalesce(b, F.lit(0)).cast("long").alias("before"), a.cast("long").alias("after"))
        for m, f, b, a in entries])))
    return tidy.where((F.col("metric") != "invalid_reason") | (F.col("before") > 0)).orderBy("metric", "field")


# ---------------------------------------------------------------- K1, K2

@dataclass
class RunSummary:
    status: str = "SUCCESS"
    failed_stage: str | None = None
    error_type: str | None = None
    error_message: str | None = None
    records_ingested: int = 0
    records_valid: int = 0
    records_invalid: int = 0
    records_persisted: int = 0
    runtime_seconds: float = 0.0
    intelligence: dict = field(default_factory=dict)

    def as_row(self) -> dict:
        d = dict(self.__dict__)
        d.pop("intelligence")
        return d


def run_breakdown(spark: SparkSession, summary: RunSummary) -> tuple[DataFrame, DataFrame]:
    """The run metrics as one row and the valid/invalid breakdown as
    two rows (from a finished run's counts)."""
    metrics = spark.createDataFrame(
        [(summary.records_ingested, summary.records_valid, summary.records_invalid,
          summary.records_persisted, float(summary.runtime_seconds), summary.status)],
        "records_ingested long, records_valid long, records_invalid long, "
        "records_persisted long, runtime_seconds double, status string")
    breakdown = spark.createDataFrame(
        [("valid", summary.records_valid), ("invalid", summary.records_invalid)],
        "status string, count long")
    return metrics, breakdown


def run_pipeline(spark: SparkSession, source: str | None, store_path: str, data_format: str | None = None,
                 store_format: str = "json", summary_path: str | None = None,
                 options: dict | None = None,
                 stage_hook: Callable[[str], None] | None = None,
                 mode: str | None = None, config: routing.StoreConfig | None = None) -> RunSummary:
    """K1: route -> read -> normalise -> adapt -> validate -> store the valid
    records -> (IQR -> severity -> evaluation, best effort) -> run summary.

    ``mode`` and ``config`` route the source (A12).  A failing stage marks the
    run FAILED and names the stage; persisted is 0 then, and the store keeps
    the records it had.  ``stage_hook`` is called with each stage name before
    it runs (tests use it to inject failures)."""
    t0 = time.time()
    summary = RunSummary()
    stage = "ingestion"

    def enter(name: str) -> None:
        nonlocal stage
        stage = name
        if stage_hook:
            stage_hook(name)

    try:
        enter("ingestion")
        fmt, path = routing.route(source, mode, config, data_format)
        raw = readers.normalize_loaded(readers.load(spark, path, fmt, **(options or {})))
        enter("adapter")
        canon = reshape.adapt(raw)
        enter("validation")
        counts = Observation()
        good = F.col("status") == "valid"
        checked = validate.validate(canon).observe(counts, F.count(F.lit(1)).alias("n"), F.count_if(good).alias("v"))
        enter("persistence")
        stored = store.save(checked.where(good).drop("errors", "status"), store_path, store_format)
        summary.records_ingested, summary.records_valid = counts.get["n"], counts.get["v"]
        summary.records_invalid = summary.records_ingested - summary.records_valid
        summary.records_persisted = stored["record_count"]
        stage = "intelligence"
        try:
            scored = anomaly.severity(anomaly.iqr_detect(reshape.flatten(store.load(spark, store_path, store_format))))
            ev = anomaly.evaluation(scored).first()
            summary.intelligence = ev.asDict() if ev else {}
        except Exception as exc:  # best effort
            log.warning("intelligence stage failed: %s", exc)
    except Exception as exc:
        summary.status = "FAILED"
        summary.failed_stage = stage
        summary.error_type = type(exc).__name__
        summary.error_message = str(exc)
        summary.records_persisted = 0
    summary.runtime_seconds = round(time.time() - t0, 3)
    if summary_path:
        store.write_run_summary(spark, summary.as_row(), summary_path)
    return summary


def run_dataset(spark: SparkSession, dataset_id: str, catalog: dict, store_path: str,
                summary_path: str | None = None, config=None) -> tuple[RunSummary, dict]:
    """K2: catalog lookup -> K1 -> counts + source metadata.  ``config``
    (``routing.StoreConfig``) locates entries that lie in an object store."""
    if dataset_id not in catalog:
        raise KeyError(f"Unknown dataset id: {dataset_id}")
    spec = catalog[dataset_id]
    fmt, path, opts = routing.resolve_source(spec, config)
    summary = run_pipeline(spark, path, store_path, fmt, summary_path=summary_path, options=opts)
    return summary, routing.dataset_metadata(spark, dataset_id, spec)


# ---------------------------------------------------------------- K3-K6

def model_ready(spark: SparkSession, store_path: str, store_format: str = "json") -> tuple[DataFrame, DataFrame]:
    """K3: stored records -> first numeric value -> usable rows -> typed feature
    rows, and their counts (total, valid and invalid records; B16)."""
    canon = store.load(spark, store_path, store_format)
    return reshape.feature_dataset(reshape.keep_usable(reshape.model_records(canon)))


def detect(records: DataFrame, model: str = "zscore", **params) -> tuple[DataFrame, DataFrame, dict]:
    """K4: run a detector -> (rows, summary, context)."""
    if model == "zscore":
        m = anomaly.ZScoreModel(threshold=params.get("threshold", 1.5))
    elif model == "isolation_forest":
        from sifter.operators.forest import IsolationForestModel
        m = IsolationForestModel(contamination=params.get("contamination", 0.1))
    elif model == "kmeans":
        from sifter.operators.kmeans import KMeansModel
        m = KMeansModel(n_clusters=params.get("n_clusters", 3))
    elif model == "threshold":
        m = anomaly.ThresholdModel(threshold=params["threshold"])
    else:
        raise ValueError(f"Unknown detector: {model}")
    rows = m.fit(records).transform(records)
    return rows, anomaly.detector_summary(rows), anomaly.ml_context(records)


def predict(records: DataFrame, order_by: Sequence[str], model: str = "linear",
            steps: int = 5, window: int = 2) -> tuple[DataFrame, DataFrame, dict]:
    """K5: linear trend or moving-average forecast -> (rows, summary, context).

    The summary is one row: all rows, no anomalies."""
    if model == "linear":
        rows = forecast.linear_trend(records, order_by, steps)
    elif model == "moving_average":
        rows = forecast.moving_average(records, order_by, steps, window)
    else:
        raise ValueError(f"Unknown forecaster: {model}")
    return rows, forecast.forecast_summary(rows), anomaly.ml_context(records)


def _scatter(af: DataFrame, target: str, compare: str) -> DataFrame:
    from sifter.functions.order import with_ordinal
    rows = with_ordinal(af.withColumn("_mono", F.monotonically_increasing_id()), ["_mono"]).drop("_mono")
    return charts.scatter_pairs(rows, target, compare, dates=reshape.DATE_FIELDS)


#: chart -> (what computes it, whether an empty result is an error)
CHARTS = {
    "histogram": (lambda af, t, c: charts.histogram(af, t), False),
    "boxplot": (lambda af, t, c: charts.box_stats(af, t), False),
    "bar-category": (lambda af, t, c: charts.category_counts(af, c), False),
    "grouped-comparison": (charts.grouped_mean, False),
    "grouped-boxplot": (charts.grouped_box_stats, True),
    "scatter": (_scatter, False),
    "time-line": (charts.daily_mean, True),
}


def chart_data(flat: DataFrame, chart: str, target: str = reshape.TARGET_FIELD,
               compare: str | None = None) -> DataFrame:
    """K6: one chart's data.  The chart's roles say which variables it needs; the
    target is the analysis target, a compare variable must be one of the compare
    fields, the time line's is the day, and all must be in the table."""
    if chart not in CHARTS:
        raise ValueError(f"no chart is called {chart!r}; there are {', '.join(CHARTS)}")
    compute, rows_needed = CHARTS[chart]
    roles = reshape.CHART_ROLES[chart]
    allowed = {"target_variable": [reshape.TARGET_FIELD],
               "compare_variable": reshape.DATE_FIELDS if roles.get("compare_variable") == "day" else reshape.COMPARE_FIELDS}
    given = {"target_variable": target, "compare_variable": compare}
    have = reshape.resolve_fields(flat.columns)
    for variable, label in given.items():
        if label is None and variable not in roles:
            continue
        if label not in allowed[variable]:
            raise ValueError(f"{chart}: the {variable.replace('_', ' ')} can be {' or '.join(allowed[variable])}, not {label!r}")
        if label not in have:
            raise ValueError(f"{chart}: the table has no column for {label!r}")
    out = compute(reshape.analysis_frame(flat), target, compare)
    if rows_needed and out.isEmpty():
        raise ValueError(f"{chart}: no row has both {target!r} and {compare!r}")
    return out
