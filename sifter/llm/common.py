"""Shared helpers: intermediate tables in the shared folder, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a ``local[...]`` session without that setting (a test, a laptop)
    gets a temporary folder; on a cluster the setting is required, because
    executors and driver share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="sifter-llm-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/sifter-llm/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later
    jobs start from the files, whichever executors are lost meanwhile."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._sifter_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table._sifter_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_BATCH, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers at most ``_ROWS`` at a time, unless the session
    asks for a size of its own: Spark's default of 10,000 rows is some ten
    megabytes of text, several times over, on both sides of every task."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(_ROWS))


def boxed(df: DataFrame, cols: list[str] | None = None, **named: Column) -> DataFrame:
    """The columns of ``df`` (or ``cols``) as one struct ``_row`` beside the named
    ones, so that no name of theirs can clash; ``select("_row.*")`` undoes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if cols is None else cols)])
    return df.select(row.alias("_row"), *[v.alias(k) for k, v in named.items()])


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values
    (null counts as empty), without making Python strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges (lo, hi) of consecutive values that hold at most ``limit``
    bytes together; a longer value stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def binary_array(parts: list) -> pa.Array:
    return pa.array(parts, pa.binary())
