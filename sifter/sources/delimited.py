"""Delimited text: encodings, header map per file, one type per column (A1, A2).

A folder's files may differ in encoding and in the order or choice of their
columns.  Each file's header is read from its first record; files with the same
encoding and header are one scan of strings, the scans are united by column
name, and one aggregate over all of them finds a type per column that every
value has.  Spark's own reader would apply the first file's header to all.
"""

from __future__ import annotations

import csv
import functools
import io
import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sifter.sources.heads import first_lines, first_record

# Encodings tried in order, and what Spark's reader calls those it knows.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
_CHARSETS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}


@functools.cache
def _cp1252() -> tuple[str, str, list[int]]:
    """The characters that bytes 80 to 9F stand for in Latin-1 and in cp1252, and
    the bytes that cp1252 leaves undefined."""
    known = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    defined = [b for b in known if known[b]]
    return "".join(map(chr, defined)), "".join(known[b] for b in defined), [b for b in known if not known[b]]


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """Per file: ``utf-8`` when it decodes as UTF-8, else ``cp1252`` unless a
    byte undefined in cp1252 occurs, else ``latin-1`` (which never fails).

    One distributed pass over whole files: the text reader keeps each line's
    raw bytes, ``is_valid_utf8`` checks them, and the hex form of the bytes
    is searched for the undefined bytes at byte boundaries."""
    undefined = "|".join(f"{b:02X}" for b in _cp1252()[2])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    odd = F.hex(F.col("value").cast("binary")).rlike(f"^(..)*?({undefined})")
    per_file = lines.groupBy("file").agg(F.max(~F.is_valid_utf8("value")).alias("bad"), F.max(odd).alias("odd"))
    return per_file.select("file", F.when(~F.col("bad"), "utf-8").when(F.col("odd"), "latin-1").otherwise("cp1252").alias("encoding"))


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header record: blank cells are ``_c0``, ``_c1``, … by
    place, and a name that occurred (in any case, as Spark resolves names) gets
    its occurrence as a suffix."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = cell.strip() or f"_c{i}"
        taken = {n.lower() for n in out}
        turn = 2
        fresh = name
        while fresh.lower() in taken:
            fresh, turn = f"{name}_{turn}", turn + 1
        out.append(fresh)
    return out


def _cells(record: bytes, encoding: str, sep: str) -> list[str]:
    text = record.decode("cp1252" if encoding == "cp1252" else _CHARSETS.get(encoding, encoding), "replace")
    return next(csv.reader(io.StringIO(text.lstrip("\ufeff"), newline=""), delimiter=sep), [])


def _literal_path(file: str) -> str:
    """A file's path as the reader takes it: not percent-encoded, no wildcards."""
    return "".join("\\" + ch if ch in "{}[]*?\\" else ch for ch in urllib.parse.unquote(file))


def _scan(spark: SparkSession, files: str | list[str], names: list[str], encoding: str, settings: dict) -> DataFrame:
    """One header and encoding: every column as a string, under its name."""
    ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    known = encoding if encoding not in ENCODINGS else _CHARSETS.get(encoding, _CHARSETS["latin-1"])
    rows = spark.read.options(**settings).option("encoding", known).schema(ddl).csv(files)
    def value(c: str) -> Column:
        return F.translate(c, *_cp1252()[:2]) if encoding == "cp1252" else F.col(c)
    return rows.select(*[value(f"c{i}").alias(n) for i, n in enumerate(names)])


# Patterns of the values that a type admits, tried in this order; casting must succeed too.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_TYPES = (("int", r"^\s*[+-]?\d+\s*$"), ("bigint", r"^\s*[+-]?\d+\s*$"), ("double", _NUMBER), ("date", r"^\d{4}-\d{1,2}-\d{1,2}$"),
          ("timestamp", r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}.*)?$"), ("boolean", r"^(?i)(true|false)$"))


def typed(strings: DataFrame) -> DataFrame:
    """Each column as the first of int, bigint, double, date, timestamp and boolean
    that all its values have, else as strings.  One aggregate over the table; a
    column without values stays a string."""
    def fits(c: str, kind: str, pattern: str) -> Column:
        return F.bool_and(F.when(F.col(c).isNotNull(), F.col(c).rlike(pattern) & F.col(c).try_cast(kind).isNotNull()))

    cols = [f"`{c}`" for c in strings.columns]
    tests = [fits(c, kind, pattern).alias(f"{kind}{i}") for i, c in enumerate(cols) for kind, pattern in _TYPES]
    row = strings.agg(*tests).first() if cols else None
    kinds = [next((kind for kind, _ in _TYPES if row[f"{kind}{i}"]), None) for i in range(len(cols))]
    return strings.select(*[(F.col(c).try_cast(kind) if kind else F.col(c)).alias(n) for c, kind, n in zip(cols, kinds, strings.columns)])


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None,
             infer_schema: bool = True, header: bool = True, multiline: bool | None = None, **options) -> DataFrame:
    """A1/A2: CSV (TSV with ``sep='\\t'``) of one file or a folder.

    Columns are matched by each file's own header; a column that a file lacks is
    null in its rows.  Without ``header`` columns are ``_c0``, ``_c1``, … by place.
    A doubled quote inside quotes is one quote.  ``multiline`` (one task per file,
    for line breaks inside quotes) is looked up when it isn't given: only a
    table with an odd number of quotes on some line needs it.  Without
    ``encoding`` each file's is detected.

    The driver sees each file's name, encoding and header, as Spark's own file
    index has the names there anyway.  No session setting is changed.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
        multiline = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    settings = {"header": str(header).lower(), "sep": sep, "escape": '"', "multiLine": str(multiline).lower(), **options}
    heads = first_lines(spark, path, first_record)
    found = {} if encoding else {r["file"]: r["encoding"] for r in detect_encodings(spark, path).collect()}
    layouts: dict[tuple, list] = {}
    for file, head in heads:
        known = encoding or found.get(file, ENCODINGS[0])
        cells = _cells(head, known, sep)
        names = header_names(cells) if header else [f"_c{i}" for i in range(len(cells))]
        layouts.setdefault((known, tuple(names)), []).append(file)
    if not layouts:
        return spark.read.options(**settings).csv(path)
    parts = [_scan(spark, path if len(layouts) == 1 else [_literal_path(f) for f in files], list(names), enc, settings)
             for (enc, names), files in layouts.items()]
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return typed(out) if infer_schema else out


def read_tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_csv(spark, path, sep="\t", **kw)
