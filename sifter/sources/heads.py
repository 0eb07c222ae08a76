"""The first lines of every file of a folder, without reading the rest (A10, A1).

The files come from Spark's listing (no content is loaded), and of each one only
the chunks that hold the wanted lines are read, by Hadoop's file system, so any
store that Spark reads works.  A file costs one chunk whatever its size.  The
reads run on the driver, some at a time, because no Spark source stops a scan
inside a task for Python's sake: a ``mapInArrow`` that takes one line still has
the whole file sent to it.  What the driver keeps is a line per file, beside
the file's status in Spark's own index.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterator

from pyspark.sql import SparkSession, functions as F

CHUNK = 1 << 16
_AT_A_TIME = 16


def _lines(stream) -> Iterator[bytes]:
    """Lines of a Java stream as raw bytes, split at line feeds, read chunk by chunk."""
    rest = b""
    while chunk := bytes(stream.readNBytes(CHUNK)):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def first_lines(spark: SparkSession, path: str, pick: Callable[[Iterator[bytes]], bytes]) -> list[tuple[str, bytes]]:
    """(file, head) per file that isn't empty, by file: ``pick`` gets the file's
    lines and takes as many as it wants."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def head(file: str) -> tuple[str, bytes]:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = where.getFileSystem(conf).open(where)
        try:
            return file, pick(_lines(stream))
        finally:
            stream.close()

    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("f"), "length")
    files = sorted(r["f"] for r in listed.collect() if r["length"])
    with ThreadPoolExecutor(_AT_A_TIME) as pool:
        return list(pool.map(head, files))


def opening(lines: Iterator[bytes]) -> bytes:
    """The first four bytes and the first line, whichever is longer."""
    out = next(lines, b"")
    for line in lines:
        out += b"\n"
        if len(out) >= 4:
            break
        out += line
    return out


def first_record(lines: Iterator[bytes]) -> bytes:
    """The first line that isn't blank, with the lines that an open quote adds."""
    out = b""
    for line in lines:
        out += line
        if out.count(b'"') % 2 == 0 and out.strip():
            break
        out = out + b"\n" if out.strip() else b""
    return out.removesuffix(b"\n").removesuffix(b"\r")
