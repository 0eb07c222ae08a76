"""Source routing, object-store paths and the dataset catalog.

Routing decides *what* to read (format, path, options); the readers in
``sifter.sources.readers`` do the reading.  Object-store access is a Hadoop
filesystem path handed to the same readers; credentials are cluster
configuration, not code.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sifter.sources import readers

WORKBOOK_SUFFIXES = (".xlsx", ".xlsm", ".xltx", ".xltm")


def object_store_path(account: str, container: str, path: str) -> str:
    """``abfss://container@account.dfs.core.windows.net/path``."""
    return f"abfss://{container}@{account}.dfs.core.windows.net/{path.lstrip('/')}"


#: fixed values: format by the last suffix of an object's name
SUFFIX_FORMATS = {"json": "json", "parquet": "parquet"} | {x.lstrip("."): "xlsx" for x in WORKBOOK_SUFFIXES}


def format_from_suffix(path: str) -> str:
    """The format of an object by its suffix; csv for any other."""
    return SUFFIX_FORMATS.get(path.rpartition(".")[2], "csv")


def read_object(spark: SparkSession, account: str, container: str, path: str,
                fmt: str | None = None, normalise: bool = True) -> DataFrame:
    """A8 (and A9 with ``fmt='csv', normalise=False``)."""
    full = object_store_path(account, container, path)
    df = readers.load(spark, full, fmt or format_from_suffix(path))
    return readers.normalize_loaded(df) if normalise else df


def read_object_csv(spark: SparkSession, account: str, container: str, path: str) -> DataFrame:
    """Object-store CSV without the normaliser."""
    return read_object(spark, account, container, path, "csv", normalise=False)


@dataclass
class StoreConfig:
    """Object-store defaults (account and container) for routing."""
    account: str | None = None
    container: str | None = None
    path: str | None = None


def route(source_path: str | None = None, mode: str | None = None,
          config: StoreConfig | None = None, data_format: str | None = None) -> tuple[str | None, str]:
    """Decide (format, full path) for a source.

    * ``mode='local'``: the explicit path only, no object-store fallback;
    * ``mode='cloud'``: the configured object-store path only;
    * explicit ``sql://`` paths go to JDBC;
    * a ``container/blob`` style path (relative, not ``./``/``../``, not an
      existing local path) is read from the object store when one is
      configured; anything else is a local path.
    """
    config = config or StoreConfig()
    stored = config.account and config.container and config.path
    needs = {"local": (source_path, "mode 'local' needs a source path"),
             "cloud": (stored, "mode 'cloud' needs account, container and path of the store")}
    given, complaint = needs.get(mode, (source_path, "no source given"))
    if not given:
        raise ValueError(complaint)
    if mode == "cloud":
        return _stored(config.account, config.container, config.path, data_format)
    if mode != "local":
        if source_path.startswith("sql://"):
            return "sql", source_path
        blob = _BLOB.fullmatch(source_path)
        if config.account and blob and not os.path.exists(source_path):
            return _stored(config.account, blob["container"], blob["blob"], data_format)
    return data_format, source_path


#: container/blob: relative, no scheme, no leading dot folder
_BLOB = re.compile(r"(?!\.{0,2}/)(?!.*://)(?P<container>[^/]+)/(?P<blob>.+)")


def _stored(account: str, container: str, blob: str, data_format: str | None) -> tuple[str, str]:
    return data_format or format_from_suffix(blob), object_store_path(account, container, blob)


def resolve_source(spec: dict, config: StoreConfig | None = None) -> tuple[str | None, str, dict]:
    """A catalog entry -> (format, path, reader options).  A SQL entry
    names database, schema and table, and its ``jdbc_url``."""
    if spec.get("source_type") == "sql":
        path = "sql://" + "/".join(spec[k] for k in ("database", "schema", "table"))
        return "sql", path, {"url": spec.get("jdbc_url")} | dict(spec.get("options") or {})
    fmt, path = route(spec.get("path"), None, config, spec.get("format"))
    return fmt, path, {}


_DESCRIPTOR = ("source_type", "source_name", "source_url", "source_location", "database", "schema", "table", "path")


def catalog_frame(spark: SparkSession, catalog: dict) -> DataFrame:
    """One row per entry of the caller's catalog: id, type, name
    (default: the id), url and location (default: the path, or the SQL path)."""
    rows = [(k, *(None if v.get(f) is None else str(v[f]) for f in _DESCRIPTOR)) for k, v in catalog.items()]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("dataset_id", *_DESCRIPTOR)))
    sql_path = F.when(F.col("source_type") == "sql", F.concat(F.lit("sql://"), F.concat_ws("/", "database", "schema", "table")))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return raw.select("dataset_id", "source_type", F.coalesce(blank("source_name"), "dataset_id").alias("source_name"),
                      "source_url", F.coalesce(blank("source_location"), sql_path, "path").alias("source_location"))


def dataset_metadata(spark: SparkSession, dataset_id: str, spec: dict) -> dict:
    """A14 for one entry."""
    return catalog_frame(spark, {dataset_id: spec}).first().asDict()


def register_catalog(spark: SparkSession, catalog: dict, loader=None, config: StoreConfig | None = None) -> list[str]:
    """A13 as temp views: every loadable entry becomes a view named by its id.
    Entries whose source is missing or unreadable for Spark are returned."""
    skipped = []
    for ds_id, spec in catalog.items():
        try:
            fmt, path, opts = resolve_source(spec, config)
            (loader or readers.load)(spark, path, fmt, **opts).createOrReplaceTempView(ds_id)
        except (AnalysisException, ValueError):
            skipped.append(ds_id)
    return skipped
