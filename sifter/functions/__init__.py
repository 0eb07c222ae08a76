"""Column-level helpers (scalar functions) and distributed order helpers."""

from sifter.functions.cols import (  # noqa: F401
    missing, not_missing, nan_to_null, safe_double, safe_int, iso_string,
    norm_field_name, truncate_label, is_numeric, numeric_columns, NUMBER_PATTERN,
    INT_PATTERN, ISO_PATTERN, try_timestamp,
)
from sifter.functions.order import (  # noqa: F401
    with_ordinal, running_total,
)
from sifter.functions.quantile import column_quantiles, quantiles  # noqa: F401
from sifter.functions.cache import persisted, release  # noqa: F401
