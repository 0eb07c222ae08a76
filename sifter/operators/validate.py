"""Validation, duplicate detection and quality reports (C, F2, E20-E24).

Errors are an ``array<string>`` column built from ``when`` expressions, so
validation is a projection: no row leaves the JVM.  "Missing" is null or NaN
everywhere (a blank CSV id or timestamp is rejected).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.cache import persisted
from sifter.functions.cols import ISO_PATTERN, missing

# Error and warning texts.
MISSING_ENTITY = "Missing entity_id"
MISSING_TIMESTAMP = "Missing timestamp"
MISSING_FEATURES = "Missing features"
FEATURES_NOT_DICT = "Features must be a dictionary"
MISSING_METADATA = "Missing metadata"
INVALID_TIMESTAMP = "Invalid timestamp format"
DUPLICATES_WARNING = "Duplicate records detected"
REQUIRED_RAW_FIELDS = ("timestamp", "source", "event_type")
RECORD_ERRORS = (MISSING_ENTITY, MISSING_TIMESTAMP, MISSING_FEATURES, FEATURES_NOT_DICT,
                 MISSING_METADATA)


def _missing_of(df: DataFrame, name: str):
    if name not in df.columns:
        return F.lit(True)
    return missing(F.col(name), df.schema[name].dataType)


# ---------------------------------------------------------------- C1

def has_required_fields(df: DataFrame, required: Sequence[str] = REQUIRED_RAW_FIELDS) -> bool:
    """C1 on a typed table: every required field is a column."""
    return all(r in df.columns for r in required)


def required_fields_present(map_col: str = "record",
                            required: Sequence[str] = REQUIRED_RAW_FIELDS):
    """C1 per row for map-typed raw records: all required keys present."""
    cond = F.lit(True)
    for r in required:
        cond = cond & F.array_contains(F.map_keys(F.col(map_col)), r)
    return cond


# ---------------------------------------------------------------- C2-C4

def validation_errors(df: DataFrame):
    """Ordered error list of a canonical record."""
    ftype = df.schema["features"].dataType if "features" in df.columns else None
    checks = [
        F.when(_missing_of(df, "entity_id"), F.lit(MISSING_ENTITY)),
        F.when(_missing_of(df, "timestamp"), F.lit(MISSING_TIMESTAMP)),
    ]
    if ftype is None:
        checks.append(F.lit(MISSING_FEATURES))
    elif isinstance(ftype, (T.StructType, T.MapType)):
        checks.append(F.when(F.col("features").isNull(), F.lit(MISSING_FEATURES)))
    else:
        checks.append(F.when(F.col("features").isNull(), F.lit(MISSING_FEATURES))
                      .otherwise(F.lit(FEATURES_NOT_DICT)))
    checks.append(F.when(_missing_of(df, "metadata"), F.lit(MISSING_METADATA)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(canon: DataFrame) -> DataFrame:
    """Add ``errors`` and ``status`` (valid / invalid)."""
    errs = validation_errors(canon)
    return canon.withColumn("errors", errs) \
                .withColumn("status", F.when(F.size("errors") == 0, "valid").otherwise("invalid"))


def split_valid(canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) records; the validated frame is persisted once so
    that both filters read it."""
    checked = validate(canon).transform(persisted)
    valid = checked.where(F.col("status") == "valid").drop("errors", "status")
    invalid = checked.where(F.col("status") == "invalid")
    return valid, invalid


def batch_validation(canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: one-row totals and the invalid rows ``(record_index, errors)``.

    The rows carry ``record_index`` if ``canon`` does (see ``with_ordinal``)."""
    checked = validate(canon)
    invalid = F.col("status") == "invalid"
    totals = checked.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~invalid).alias("valid_records"),
        F.count_if(invalid).alias("invalid_records"),
    ).withColumn("status", F.when(F.col("invalid_records") > 0, "invalid").otherwise("valid"))
    rows = checked.where(invalid).select(*[c for c in ("record_index", "errors") if c in checked.columns])
    return totals, rows


def invalid_reason_counts(checked: DataFrame) -> DataFrame:
    """Count per error message over validated records."""
    return (checked.select(F.explode("errors").alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("count")))


def validation_report(totals: DataFrame) -> DataFrame:
    """The C4 totals under report names."""
    return totals.select(
        F.coalesce(F.col("status"), F.lit("invalid")).alias("dataset_status"),
        F.coalesce(F.col("total_records"), F.lit(0)).alias("records_processed"),
        F.coalesce(F.col("valid_records"), F.lit(0)).alias("valid_records"),
        F.coalesce(F.col("invalid_records"), F.lit(0)).alias("invalid_records"))


def quality_report(totals: DataFrame, duplicate_rows: DataFrame) -> DataFrame:
    """Report totals + duplicate count + warnings (one row).

    The duplicate count is a scalar (one ``count`` action); it enters the
    report as a literal."""
    n_dup = duplicate_rows.count()
    rep = validation_report(totals)
    return rep.select(
        F.lit("validation").alias("pipeline_stage"), "dataset_status", "records_processed",
        "valid_records", "invalid_records", F.lit(n_dup).cast("long").alias("duplicate_records"),
        (F.array(F.lit(DUPLICATES_WARNING)) if n_dup > 0
         else F.array().cast("array<string>")).alias("warnings"))


# ---------------------------------------------------------------- C5, C6

def timestamp_errors(c: str, dtype: T.DataType):
    """Missing timestamp / Invalid timestamp format.

    Strings must be extended ISO-8601 and parse; timestamp- and date-typed
    values are valid; any other type is invalid."""
    col = F.col(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        bad = F.lit(False)
    elif isinstance(dtype, T.StringType):
        parsed = F.try_to_timestamp(F.regexp_replace(col, "Z$", "+00:00"))
        bad = ~col.rlike(ISO_PATTERN) | parsed.isNull()
    else:
        bad = F.lit(True)
    return F.when(col.isNull(), F.array(F.lit(MISSING_TIMESTAMP))) \
            .when(bad, F.array(F.lit(INVALID_TIMESTAMP))) \
            .otherwise(F.array().cast("array<string>"))


def feature_errors(df: DataFrame, c: str = "features"):
    """Missing features / not a dictionary / one message per null value,
    in key order."""
    dtype = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dtype, T.StructType):
        per_key = [F.when(col.getField(f.name).isNull(),
                          F.lit(f"Feature '{f.name}' is missing a value"))
                   for f in dtype.fields]
        body = F.filter(F.array(*per_key), lambda x: x.isNotNull()) if per_key \
            else F.array().cast("array<string>")
    elif isinstance(dtype, T.MapType):
        body = F.transform(F.map_keys(F.map_filter(col, lambda k, v: v.isNull())),
                           lambda k: F.concat(F.lit("Feature '"), k, F.lit("' is missing a value")))
    else:
        body = F.array(F.lit(FEATURES_NOT_DICT))
    return F.when(col.isNull(), F.array(F.lit(MISSING_FEATURES))).otherwise(body)


# ---------------------------------------------------------------- F2, C7-C12

def duplicates(canon: DataFrame, keys: Sequence[str] = ("entity_id", "timestamp"),
               index: str = "record_index") -> DataFrame:
    """every row after the first (by ``index``) of a repeated key.

    Rows with a missing key part are skipped.  The first index per key is a
    map-side-combined aggregate; rows are joined back to it, so a key holding
    a third of all rows is never gathered into one window partition (AQE's
    skew-join splits it in the join instead)."""
    keys = list(keys)
    ok = F.lit(True)
    for k in keys:
        ok = ok & ~missing(F.col(k), canon.schema[k].dataType)
    keyed = canon.where(ok).select(index, *keys)
    first = keyed.groupBy(*keys).agg(F.min(index).alias("_first"), F.count(F.lit(1)).alias("_n")) \
                 .where(F.col("_n") > 1).drop("_n")
    return (keyed.join(first, keys)
            .where(F.col(index) > F.col("_first"))
            .select(index, *keys))


def entity_lookup(df: DataFrame, entity_id) -> DataFrame:
    """Rows whose entity_id equals ``entity_id`` compared as strings.

    For numeric ids the comparison is made on the native column when the
    text is a plain integer, so Parquet can push it down."""
    dtype = df.schema["entity_id"].dataType
    text = str(entity_id)
    if isinstance(dtype, T.IntegralType) and text.lstrip("-").isdigit():
        return df.where(F.col("entity_id") == F.lit(int(text)))
    return df.where(F.col("entity_id").cast("string") == F.lit(text))


def future_rows(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forecast rows (timestamp ``t+k``) and total/future counts."""
    fut = F.col("timestamp").startswith("t+")
    counts = pred.agg(F.count(F.lit(1)).alias("total"), F.count_if(fut).alias("future"))
    return pred.where(fut), counts


def anomalous_rows(scored: DataFrame) -> DataFrame:
    """C9."""
    return scored.where(F.col("is_anomaly"))


def drop_missing_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C11: drop rows where any listed column is null or NaN."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~missing(F.col(f"`{c}`"), df.schema[c].dataType)
    return df.where(cond)


def sanitize(df: DataFrame, digits: int | None = None) -> DataFrame:
    """NaN/Inf -> null on floating columns, optional rounding."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), None).otherwise(c)
            if digits is not None:
                c = F.round(c, digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)
