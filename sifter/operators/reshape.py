"""Reshaping raw tables into canonical records and back (B-series).

Canonical record schema::

    entity_id   <source type>      first column whose name contains "id"
    timestamp   string (ISO-8601)  first column containing "time" or "date"
    features    struct<...>        every other column, native types
    metadata    map<string,string> empty from the adapter

All functions are ``DataFrame -> DataFrame`` and compose with
``df.transform``.  Column roles are decided from the schema alone; no row is
read to decide them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.cols import (
    is_numeric, iso_string, missing, nan_to_null, norm_field_name, safe_double,
    safe_int,
)

CANONICAL_META = T.MapType(T.StringType(), T.StringType())


@dataclass
class Roles:
    """Which columns play entity, timestamp and feature."""
    entity: list[str] = field(default_factory=list)
    timestamp: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)


# ---------------------------------------------------------------- B6, B7

def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case every column name; error on collisions."""
    names = [c.strip().lower() for c in df.columns]
    seen: dict[str, int] = {}
    for n in names:
        seen[n] = seen.get(n, 0) + 1
    clashes = sorted(n for n, k in seen.items() if k > 1)
    if clashes:
        raise ValueError(f"Column names collide after normalisation: {clashes}")
    return df.toDF(*names)


def classify_columns(columns: Sequence[str]) -> Roles:
    """Per column, in order: contains ``id`` -> entity; else contains
    ``time`` or ``date`` -> timestamp; else feature."""
    roles = Roles()
    for c in columns:
        if "id" in c:
            roles.entity.append(c)
        elif "time" in c or "date" in c:
            roles.timestamp.append(c)
        else:
            roles.features.append(c)
    return roles


# ---------------------------------------------------------------- B8, B9

def to_canonical(df: DataFrame, roles: Roles | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Project to the canonical record.

    The first entity and first timestamp column are used; other id/time
    columns are dropped.  The timestamp is rendered once to an ISO string.
    ``keep`` columns (e.g. ``record_index``) are carried alongside, outside
    the record.
    """
    keep = list(keep)
    roles = roles or classify_columns([c for c in df.columns if c not in keep])
    wanted = {"entity_id (a name with 'id')": roles.entity, "timestamp (a name with 'time' or 'date')": roles.timestamp}
    if absent := [what for what, found in wanted.items() if not found]:
        raise ValueError(f"no column for {' or '.join(absent)}; the table's columns are {', '.join(df.columns)}")
    e, t = roles.entity[0], roles.timestamp[0]
    ts_type = df.schema[t].dataType
    feats = [F.col(f"`{c}`") for c in roles.features if c not in keep]
    features = F.struct(*feats)
    return df.select(
        *[F.col(f"`{k}`") for k in keep],
        F.col(f"`{e}`").alias("entity_id"),
        iso_string(F.col(f"`{t}`"), ts_type).alias("timestamp"),
        features.alias("features"),
        F.create_map().cast(CANONICAL_META).alias("metadata"),
    )


def adapt(df: DataFrame, roles: Roles | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Normalise names, classify, project to canonical records."""
    norm = normalize_columns(df)
    keep = [k.strip().lower() for k in keep]
    return to_canonical(norm, roles or classify_columns([c for c in norm.columns if c not in keep]),
                        keep)


# ---------------------------------------------------------------- B10, B11

def feature_names(canon: DataFrame) -> list[str]:
    ftype = canon.schema["features"].dataType
    if isinstance(ftype, T.StructType):
        return [f.name for f in ftype.fields]
    raise TypeError("features must be a struct column")


def flatten(canon: DataFrame) -> DataFrame:
    """entity_id, timestamp and one column per feature."""
    cols = [F.col("entity_id"), F.col("timestamp")]
    cols += [F.col("features").getField(n).alias(n) for n in feature_names(canon)
             if n not in ("entity_id", "timestamp")]
    extra = [c for c in canon.columns if c not in ("entity_id", "timestamp", "features", "metadata")]
    return canon.select(*cols, *extra)


def flatten_with_metadata(canon: DataFrame) -> DataFrame:
    """B10 plus one ``meta_<key>`` column per metadata key.

    Keys are discovered with a distributed ``explode(map_keys) DISTINCT``;
    only the (small) set of distinct key names reaches the driver.
    """
    keys = [r[0] for r in canon.select(F.explode(F.map_keys("metadata")).alias("k"))
            .distinct().orderBy("k").collect()]
    return _attach_meta(canon, keys)


def _attach_meta(canon: DataFrame, keys: list[str]) -> DataFrame:
    flat_cols = [F.col("entity_id"), F.col("timestamp")]
    flat_cols += [F.col("features").getField(n).alias(n) for n in feature_names(canon)]
    flat_cols += [F.col("metadata").getItem(k).alias(f"meta_{k}") for k in keys]
    return canon.select(*flat_cols)


# ---------------------------------------------------------------- B12, B13

def derived_metrics(flat: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``feature_count`` = non-missing numeric columns per row,
    ``feature_sum`` = their null-skipping sum.  Default columns: every
    numeric column, a numeric entity_id included."""
    cols = list(columns) if columns is not None else \
        [f.name for f in flat.schema.fields if is_numeric(f.dataType)]
    if not cols:
        return flat
    present = [F.when(~missing(F.col(f"`{c}`"), flat.schema[c].dataType), 1).otherwise(0)
               for c in cols]
    vals = [F.coalesce(nan_to_null(F.col(f"`{c}`"), flat.schema[c].dataType), F.lit(0.0))
            for c in cols]
    count = present[0]
    for p in present[1:]:
        count = count + p
    total = vals[0]
    for v in vals[1:]:
        total = total + v
    return flat.withColumn("feature_count", count.cast("long")) \
               .withColumn("feature_sum", total.cast("double"))


def minmax_fit(flat: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """Bounded summary: (min, max) of each column, NaN ignored."""
    if not columns:
        return {}
    aggs = []
    for c in columns:
        x = nan_to_null(F.col(f"`{c}`"), flat.schema[c].dataType)
        aggs += [F.min(x).alias(f"mn_{c}"), F.max(x).alias(f"mx_{c}")]
    row = flat.agg(*aggs).first()
    return {c: (row[f"mn_{c}"], row[f"mx_{c}"]) for c in columns}


def minmax_normalise(flat: DataFrame, columns: Sequence[str] | None = None,
                     stats: dict | None = None) -> DataFrame:
    """(x-min)/(max-min) per numeric column; constant column -> 0.0 for
    every row (nulls too); all-null column untouched.  ``feature_count`` and
    ``feature_sum`` are not rescaled."""
    cols = list(columns) if columns is not None else \
        [f.name for f in flat.schema.fields if is_numeric(f.dataType)
         and f.name not in ("feature_count", "feature_sum")]
    stats = stats if stats is not None else minmax_fit(flat, cols)
    out = flat
    for c in cols:
        mn, mx = stats[c]
        if mn is None or mx is None:
            continue
        x = nan_to_null(F.col(f"`{c}`"), flat.schema[c].dataType)
        if mx == mn:
            out = out.withColumn(c, F.lit(0.0))
        else:
            out = out.withColumn(c, (x - F.lit(mn)) / F.lit(float(mx - mn)))
    return out


# ---------------------------------------------------------------- B14-B17

def first_numeric_value(canon: DataFrame, name: str = "value") -> DataFrame:
    """The first feature, in column order, that parses as a finite
    number (numeric strings and booleans count)."""
    ftype = canon.schema["features"].dataType
    parsed = [safe_double(F.col("features").getField(f.name), f.dataType)
              for f in ftype.fields]
    value = F.coalesce(*parsed) if parsed else F.lit(None).cast("double")
    return canon.withColumn(name, value)


def model_records(canon: DataFrame) -> DataFrame:
    """K3 projection: ``entity_id``/``timestamp`` as strings plus ``value``."""
    with_value = first_numeric_value(canon)
    cols = [F.col("entity_id").cast("string").alias("entity_id"),
            F.col("timestamp").cast("string").alias("timestamp"),
            F.col("value")]
    extra = [c for c in ("record_index", "label") if c in canon.columns]
    return with_value.select(*extra, *cols)


def keep_usable(records: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a usable value; when there are none, every row."""
    usable = records.where(F.col(value).isNotNull())
    return usable if usable.limit(1).count() > 0 else records


def coerce_float(c, dtype: T.DataType):
    """Null or "" -> null, unparsable -> null."""
    return safe_double(c, dtype)


def coerce_int(c, dtype: T.DataType):
    return safe_int(c, dtype)


def feature_dataset(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed model records + a one-row count table.

    A row is valid when entity_id and timestamp are non-empty strings and the
    value parsed.  All rows are kept.  (A null id is invalid here; the
    reference's ``str(None)`` would count it as valid.)
    """
    sch = records.schema
    value = coerce_float(F.col("value"), sch["value"].dataType) if "value" in sch.names \
        else F.lit(None).cast("double")
    label = coerce_int(F.col("label"), sch["label"].dataType) if "label" in sch.names \
        else F.lit(None).cast("long")
    typed = records.select(
        *([F.col("record_index")] if "record_index" in sch.names else []),
        F.col("entity_id").cast("string").alias("entity_id"),
        F.col("timestamp").cast("string").alias("timestamp"),
        value.alias("value"), label.alias("label"))
    valid = (F.coalesce(F.length("entity_id"), F.lit(0)) > 0) & \
            (F.coalesce(F.length("timestamp"), F.lit(0)) > 0) & F.col("value").isNotNull()
    counts = typed.agg(F.count(F.lit(1)).alias("total_records"),
                       F.count_if(valid).alias("valid_records"),
                       F.count_if(~valid).alias("invalid_records"))
    return typed, counts


# ---------------------------------------------------------------- B18-B20

# The analysis fields and the column names each one accepts.
TARGET_FIELD = "Sales"
COMPARE_FIELDS = ["Profit", "Quantity", "Discount", "Category", "Order Date"]
ANALYSIS_FIELDS = [TARGET_FIELD, *COMPARE_FIELDS]
FIELD_CANDIDATES = {
    "Sales": ("sales",),
    "Profit": ("profit",),
    "Quantity": ("quantity",),
    "Discount": ("discount",),
    "Category": ("category",),
    "Order Date": ("order date", "order_date", "timestamp"),
}
NUMERIC_FIELDS = ["Sales", "Profit", "Quantity", "Discount"]
DATE_FIELDS = ["Order Date"]
CATEGORY_FIELDS = ["Category"]


def resolve_fields(columns: Sequence[str]) -> dict[str, str]:
    """Analysis label -> column.  Names are compared without case, blanks
    and underscores; a label takes the first of its candidates that the table
    has, and of columns with one such name the last."""
    place = {norm_field_name(c): c for c in columns}
    hits = {label: [place[n] for n in map(norm_field_name, names) if n in place] for label, names in FIELD_CANDIDATES.items()}
    return {label: found[0] for label, found in hits.items() if found}


def numeric_column_names(df: DataFrame) -> list[str]:
    """Numeric columns (booleans excluded)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


# The variables that each chart shows, by role.
CHART_ROLES = {
    "histogram": {"target_variable": "target"},
    "boxplot": {"target_variable": "target"},
    "bar-category": {"compare_variable": "compare"},
    "scatter": {"target_variable": "target", "compare_variable": "compare"},
    "grouped-comparison": {"target_variable": "target", "compare_variable": "compare"},
    "grouped-boxplot": {"target_variable": "target", "compare_variable": "compare"},
    "time-line": {"target_variable": "target", "compare_variable": "day"},
}


def chart_roles(columns: Sequence[str], compare: str | None = "Profit") -> dict[str, str | None]:
    """The label in each role: the target, the wanted compare variable (else the
    first one there is) and the day; None where the table has none."""
    have = resolve_fields(columns)
    ranked = {"target": [TARGET_FIELD], "compare": [compare, *COMPARE_FIELDS], "day": DATE_FIELDS}
    return {role: next((label for label in labels if label in have), None) for role, labels in ranked.items()}


def chart_context(columns: Sequence[str], compare: str = "Profit") -> dict:
    """Chart -> variable -> label."""
    roles = chart_roles(columns, compare)
    return {chart: {variable: roles[role] for variable, role in wanted.items()} for chart, wanted in CHART_ROLES.items()}


def analysis_frame(flat: DataFrame) -> DataFrame:
    """Project a flat frame to the resolved analysis fields, named by label.

    ``Order Date`` is parsed to a timestamp (null when unparsable)."""
    from sifter.functions.cols import try_timestamp
    resolved = resolve_fields(flat.columns)
    cols = []
    for label, c in resolved.items():
        dt = flat.schema[c].dataType
        col = F.col(f"`{c}`")
        cols.append((try_timestamp(col, dt) if label == "Order Date" else col).alias(label))
    return flat.select(*cols)
