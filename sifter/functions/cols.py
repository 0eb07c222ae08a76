"""Scalar column helpers shared by every operator.

The reference mixes ``None`` and ``NaN`` as "missing"; sifter uses one rule,
``missing(c) = c IS NULL OR isnan(c)``, and turns NaN into null on entry to
any numeric operator (Spark orders NaN above every number and lets it
poison ``avg``/``max``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns (semantics of the number and timestamp parsers we accept).
# A number: optional sign, digits with optional fraction (or a bare fraction),
# optional exponent, surrounding blanks allowed.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# An integer: optional sign and digits only.
INT_PATTERN = r"^\s*[+-]?\d+\s*$"
# Extended ISO-8601 date or date-time: YYYY-MM-DD[(T| )hh[:mm[:ss[.f]]][Z|+hh:mm]]
ISO_PATTERN = (r"^\d{4}-\d{2}-\d{2}"
               r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")

_FLOATING = (T.DoubleType, T.FloatType)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric in the pandas ``select_dtypes('number')`` sense: no booleans."""
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and f.name not in exclude]


def missing(c, dtype: T.DataType | None = None) -> Column:
    """Null, or NaN for floating columns."""
    col = _c(c)
    if dtype is None or isinstance(dtype, _FLOATING):
        if dtype is None:
            return col.isNull()
        return col.isNull() | F.isnan(col)
    return col.isNull()


def not_missing(c, dtype: T.DataType | None = None) -> Column:
    return ~missing(c, dtype)


def nan_to_null(c, dtype: T.DataType | None = None) -> Column:
    """Double view of a numeric column with NaN and +-Inf mapped to null.
    Text is parsed like ``safe_double``; other types give null (ANSI mode
    would raise on a plain cast)."""
    if isinstance(dtype, T.StringType):
        return safe_double(c, dtype)
    if dtype is not None and not isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast("double")
    col = _c(c).cast("double")
    if dtype is not None and not isinstance(dtype, _FLOATING):
        return col
    return F.when(F.isnan(col) | col.isin(float("inf"), float("-inf")), None).otherwise(col)


def safe_double(c, dtype: T.DataType) -> Column:
    """Parse to double, null when the value is not a finite number.

    Numbers pass, booleans become 1.0/0.0 (as Python's ``float(True)``),
    strings must match ``NUMBER_PATTERN`` first; dates and other types give
    null.
    """
    col = _c(c)
    if isinstance(dtype, T.BooleanType):
        return col.cast("double")
    if isinstance(dtype, T.NumericType):
        return nan_to_null(col, dtype)
    if isinstance(dtype, T.StringType):
        parsed = F.when(col.rlike(NUMBER_PATTERN), F.trim(col).try_cast("double"))
        return nan_to_null(parsed, T.DoubleType())
    return F.lit(None).cast("double")


def safe_int(c, dtype: T.DataType) -> Column:
    """Parse to long: integral numbers truncate (``int(3.7) == 3``), strings
    must be integer literals (``int("3.7")`` fails)."""
    col = _c(c)
    if isinstance(dtype, (T.BooleanType, T.IntegralType)):
        return col.cast("long")
    if isinstance(dtype, T.NumericType):
        # truncates like int(3.7); out-of-range values give null
        return nan_to_null(col, dtype).try_cast("long")
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(INT_PATTERN), F.trim(col).try_cast("long"))
    return F.lit(None).cast("long")


def iso_string(c, dtype: T.DataType) -> Column:
    """Render a value the way ISO-8601 ``isoformat`` does.

    Timestamps: ``yyyy-MM-ddTHH:mm:ss`` with ``.ffffff`` only when the
    microseconds are non-zero; dates: ``yyyy-MM-dd``; strings unchanged.
    """
    col = _c(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(col, "SSSSSS")
        return F.when(micros == "000000", F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")) \
                .otherwise(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dtype, T.StringType):
        return col
    return col.cast("string")


def try_timestamp(c, dtype: T.DataType | None = None) -> Column:
    """Parse to timestamp, null when unparsable (``errors='coerce'``)."""
    col = _c(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp")
    if isinstance(dtype, T.DateType):
        return col.cast("timestamp")
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp")
    return F.try_to_timestamp(col.cast("string"))


def norm_field_name(name: str) -> str:
    """Field-name key: trimmed, lower case, underscores as spaces."""
    return str(name).strip().lower().replace("_", " ")


def norm_field_expr(c) -> Column:
    """Column form of the front-end variant: also collapses whitespace."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(c))), "_", " "), r"\s+", " ")


def truncate_label(c, max_chars: int = 18) -> Column:
    """Shorten labels longer than ``max_chars`` to ``max_chars-1`` + ellipsis."""
    col = _c(c).cast("string")
    return F.when(F.length(col) > max_chars,
                  F.concat(F.substring(col, 1, max_chars - 1), F.lit("…"))).otherwise(col)


def sanitize_number(c) -> Column:
    """NaN and +-Inf to null (JSON-safe numbers)."""
    return nan_to_null(c)
