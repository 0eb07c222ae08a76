"""Canonical record store and run-summary files.

A store is a folder of versions.  Records are written to a new version (JSON
lines or Parquet; timestamps are already ISO strings); only then a manifest, one
small file with the next number, names it.  Readers take the highest manifest,
so a job that dies while saving leaves the old records as they were, and a store
can be overwritten from a frame that reads it.  The manifest keeps the schema,
the record count, taken from the write itself, and its time.  The version before
the current one stays for readers that have begun.  Reading a missing store gives
an empty frame with the canonical schema; a folder of plain JSON or Parquet
files without manifests is read as it is.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from sifter.session import shuffle_partitions

FORMATS = ("json", "parquet")

CANONICAL_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("features", T.StructType([]), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])
# File formats cannot hold an empty struct: an emptied store is written with
# one placeholder feature.
EMPTY_STORE_SCHEMA = T.StructType([
    CANONICAL_SCHEMA["entity_id"], CANONICAL_SCHEMA["timestamp"],
    T.StructField("features", T.StructType([T.StructField("_none", T.StringType())]), True),
    CANONICAL_SCHEMA["metadata"],
])

RUN_SUMMARY_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("failed_stage", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("records_ingested", T.LongType()),
    T.StructField("records_valid", T.LongType()),
    T.StructField("records_invalid", T.LongType()),
    T.StructField("records_persisted", T.LongType()),
    T.StructField("runtime_seconds", T.DoubleType()),
    T.StructField("recorded_at", T.StringType()),
])


def _check(fmt: str) -> str:
    fmt = (fmt or "").lower()
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported storage backend: {fmt}")
    return fmt


MANIFESTS = "_manifest"
KEPT_VERSIONS = 2
_ORPHAN_MS = 24 * 3600 * 1000  # a staged version this old belongs to no running job


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _listed(spark: SparkSession, path: str) -> list:
    fs, where = _folder(spark, path)
    return list(fs.listStatus(where)) if fs.exists(where) else []


def _manifests(spark: SparkSession, path: str, last: int = 1) -> list[dict]:
    """The newest manifests, newest first."""
    names = sorted((f.getPath().getName() for f in _listed(spark, f"{path}/{MANIFESTS}")), reverse=True)
    out = []
    for name in names[:last]:
        fs, where = _folder(spark, f"{path}/{MANIFESTS}/{name}")
        stream = fs.open(where)
        try:
            out.append(json.loads(bytes(stream.readAllBytes())) | {"number": int(name.partition(".")[0])})
        finally:
            stream.close()
    return out


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    """Write the next manifest.  Its file must not exist: of two jobs that save at
    the same time one fails."""
    number = 1 + next((m["number"] for m in _manifests(spark, path)), 0)
    fs, where = _folder(spark, f"{path}/{MANIFESTS}/{number:020d}.json")
    stream = fs.create(where, False)
    try:
        stream.write(bytearray(json.dumps(entry).encode()))
    finally:
        stream.close()


def _prune(spark: SparkSession, path: str) -> None:
    """Delete what no reader of the current or the last version needs."""
    kept = {m["version"] for m in _manifests(spark, path, KEPT_VERSIONS)}
    old = {m["version"] for m in _manifests(spark, path, 1000)} - kept
    now = _dt.datetime.now().timestamp() * 1000
    for f in _listed(spark, path):
        name = f.getPath().getName()
        staged = name.startswith("v-") and name not in old  # perhaps of a job that still writes
        if name != MANIFESTS and name not in kept and (not staged or now - f.getModificationTime() > _ORPHAN_MS):
            _folder(spark, path)[0].delete(f.getPath(), True)


def save(records: DataFrame, path: str, fmt: str = "json", lookup: bool = False) -> dict:
    """Make ``records`` the store's records; returns its manifest.

    ``lookup`` lays Parquet out for C7: sorted by entity, with Bloom filters, so
    that a lookup reads the row groups that may hold the entity."""
    fmt = _check(fmt)
    spark, path = records.sparkSession, path.rstrip("/")
    counts = Observation()
    rows = records.repartitionByRange(shuffle_partitions(spark), "entity_id").sortWithinPartitions("entity_id") if lookup else records
    w = rows.observe(counts, F.count(F.lit(1)).alias("n")).write
    if lookup and fmt == "parquet":
        w = w.option("parquet.bloom.filter.enabled#entity_id", "true")
    version = f"v-{uuid.uuid4().hex}"
    (w.option("ignoreNullFields", "false").json if fmt == "json" else w.parquet)(f"{path}/{version}")
    entry = {"version": version, "format": fmt, "schema": records.schema.json(), "record_count": counts.get["n"],
             "last_updated": _dt.datetime.now(_dt.timezone.utc).isoformat(timespec="seconds")}
    _commit(spark, path, entry)
    _prune(spark, path)
    return entry


def load(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The store's current records; a missing store is empty.  The
    manifest knows the format and the schema (JSON inference would sort the
    features by name and lose the order that decides the model value)."""
    fmt, path = _check(fmt), path.rstrip("/")
    current = next(iter(_manifests(spark, path)), None)
    if current:
        schema = T.StructType.fromJson(json.loads(current["schema"]))
        if schema["features"].dataType == EMPTY_STORE_SCHEMA["features"].dataType and not current["record_count"]:
            return spark.createDataFrame([], CANONICAL_SCHEMA)
        return spark.read.schema(schema).format(current["format"]).load(f"{path}/{current['version']}")
    try:
        df = spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # an unreadable store is not an empty one
        return spark.createDataFrame([], CANONICAL_SCHEMA)
    return df if "entity_id" in df.columns else spark.createDataFrame([], CANONICAL_SCHEMA)


def reset(spark: SparkSession, path: str, fmt: str = "json") -> None:
    """Overwrite the store with an empty record set."""
    save(spark.createDataFrame([], EMPTY_STORE_SCHEMA), path, fmt)


def metadata(records: DataFrame) -> DataFrame:
    """record_count and last_updated (one row)."""
    return records.agg(F.count(F.lit(1)).alias("record_count")) \
                  .withColumn("last_updated", F.date_format(F.current_timestamp(),
                                                            "yyyy-MM-dd'T'HH:mm:ss"))


def stored_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A19 from the manifest alone: no record is read (no row: no such store)."""
    rows = [(m["record_count"], m["last_updated"]) for m in _manifests(spark, path.rstrip("/"))]
    return spark.createDataFrame(rows, "record_count long, last_updated string")


def write_run_summary(spark: SparkSession, row: dict, path: str) -> None:
    """Append one summary row (the history is the folder)."""
    vals = dict(row)
    vals["recorded_at"] = _dt.datetime.now(_dt.timezone.utc).isoformat()
    ordered = [vals.get(f.name) for f in RUN_SUMMARY_SCHEMA.fields]
    spark.createDataFrame([ordered], RUN_SUMMARY_SCHEMA).coalesce(1) \
         .write.mode("append").json(path)


def last_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """The most recent summary, or one ``no runs recorded`` row if there is
    no history; one that can't be read raises."""
    none = spark.createDataFrame([["no runs recorded"] + [None] * (len(RUN_SUMMARY_SCHEMA) - 1)], RUN_SUMMARY_SCHEMA)
    if not any(not f.getPath().getName().startswith(("_", ".")) for f in _listed(spark, path)):
        return none
    latest = spark.read.schema(RUN_SUMMARY_SCHEMA).option("mode", "FAILFAST").json(path).orderBy(F.desc("recorded_at")).limit(1)
    return none if latest.isEmpty() else latest


def export_document(df: DataFrame, path: str) -> None:
    """Write a one-row nested report (struct / array columns) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
