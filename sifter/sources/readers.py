"""Table readers and the loaded-table normaliser.

Every reader returns a DataFrame planned by Spark; formats are chosen per
file by a distributed scan when content decides (encoding, format sniffing),
never by pulling a file to the driver.  Delimited text is read in ``delimited``
(A1, A2), header rows are found in ``headers`` (B2, B3).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.cols import missing
from sifter.sources.delimited import detect_encodings, read_csv, read_tsv  # noqa: F401
from sifter.sources.headers import clean_headers, promote_header_row  # noqa: F401
from sifter.sources.heads import first_lines, opening

# Fixed value: the pattern of a part of a SQL table's name.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"


# ---------------------------------------------------------------- A3-A5

def read_json(spark: SparkSession, path: str, multiline: bool | None = None, **options) -> DataFrame:
    """A3: arrays of objects, single objects over several lines, or JSON Lines.

    Without ``multiline`` the lines decide: if every non-blank line is an
    object of its own the table is read line by line (and splits into many
    tasks), otherwise a file is one value."""
    if multiline is None:
        lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
        whole = F.col("v").rlike(r"^\{.*\}$") & F.json_object_keys("v").isNotNull()
        multiline = not lines.where(~F.coalesce(whole, F.lit(False))).isEmpty()
    r = spark.read.option("multiLine", str(multiline).lower())
    for k, v in options.items():
        r = r.option(k, v)
    return r.json(path)


def expand_single_container(df: DataFrame) -> DataFrame:
    """A4: a one-column table whose column is an object (struct) becomes the
    table of its fields; a column of arrays of objects becomes one row per
    object.  Anything else is returned unchanged."""
    if len(df.columns) != 1:
        return df
    c = df.columns[0]
    dt = df.schema[c].dataType
    if isinstance(dt, T.StructType):
        return df.where(F.col(f"`{c}`").isNotNull()).select(f"`{c}`.*")
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
        return df.select(F.inline(F.col(f"`{c}`")))
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A5."""
    return spark.read.parquet(path)


# ---------------------------------------------------------------- A7

def parse_sql_path(path: str) -> tuple[str, str, str]:
    """``sql://database/schema/table`` -> parts; each part must be an
    identifier."""
    if not path.startswith("sql://"):
        raise ValueError(f"Not a SQL path: {path}")
    parts = [p for p in path[len("sql://"):].split("/") if p]
    if len(parts) != 3:
        raise ValueError("SQL path must be sql://database/schema/table")
    for p in parts:
        if not re.match(IDENTIFIER, p):
            raise ValueError(f"Invalid SQL identifier: {p}")
    return parts[0], parts[1], parts[2]


def read_jdbc(spark: SparkSession, url: str, schema: str, table: str,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None,
              **options) -> DataFrame:
    """``SELECT *`` of ``schema.table`` through JDBC.  With a partition
    column the read is split into ``num_partitions`` parallel range queries;
    filters and projections are pushed into the SQL Spark sends."""
    for p in (schema, table):
        if not re.match(IDENTIFIER, p):
            raise ValueError(f"Invalid SQL identifier: {p}")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f"{schema}.{table}")
    if partition_column:
        r = r.option("partitionColumn", partition_column).option("lowerBound", lower) \
             .option("upperBound", upper).option("numPartitions", num_partitions or 8)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


# ---------------------------------------------------------------- A10, A11

def detect_formats(spark: SparkSession, path: str) -> DataFrame:
    """A10 as a folder job: one row per file with its detected format.

    First 4 bytes hold ``{`` or ``[`` -> json; ``PAR1`` -> parquet; ``PK`` and
    a workbook suffix -> excel; else the first line has a comma -> csv, a tab
    -> tsv, otherwise text; an empty file has no row.  The whole first line counts,
    however long; the rest of a file isn't read (``heads``)."""
    rows = [(file, head[:4], head.split(b"\n", 1)[0]) for file, head in first_lines(spark, path, opening)]
    files = spark.createDataFrame(rows, "path string, start binary, line binary")
    start, line = F.decode("start", "ISO-8859-1"), F.decode("line", "ISO-8859-1")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    fmt = (F.when(F.contains(start, F.lit("{")) | F.contains(start, F.lit("[")), "json")
           .when(start == "PAR1", "parquet")
           .when(F.startswith(start, F.lit("PK")) & suffix.isin(".xlsx", ".xlsm", ".xltx", ".xltm"), "excel")
           .when(F.contains(line, F.lit(",")), "csv")
           .when(F.contains(line, F.lit("\t")), "tsv")
           .otherwise("text"))
    return files.select("path", fmt.alias("format"))


def detect_format(spark: SparkSession, path: str) -> str:
    """A10 for one path (``sql://`` -> sql)."""
    if path.startswith("sql://"):
        return "sql"
    rows = detect_formats(spark, path).select("format").distinct().collect()
    if len(rows) != 1:
        raise ValueError(f"Mixed or no formats under {path}: {[r[0] for r in rows]}")
    return rows[0][0]


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Reader per format; unknown formats (``text`` too) are errors."""
    fmt = (fmt or detect_format(spark, path)).lower()
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt == "tsv":
        return read_tsv(spark, path, **options)
    if fmt == "json":
        return read_json(spark, path, **options)
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt in ("excel", "xlsx"):
        from sifter.sources.workbook import read_workbooks
        return read_workbooks(spark, path)
    if fmt == "sql":
        if path.startswith("sql://"):
            _, schema, table = parse_sql_path(path)
            options = {"schema": schema, "table": table} | options
        if not options.get("url"):
            raise ValueError("a SQL source needs the url of its database")
        return read_jdbc(spark, **options)
    raise ValueError(f"Unsupported data format: {fmt}")


# ---------------------------------------------------------------- B1-B5

def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows where every value is missing."""
    if not df.columns:
        return df
    any_present = F.lit(False)
    for f in df.schema.fields:
        any_present = any_present | ~missing(F.col(f"`{f.name}`"), f.dataType)
    return df.where(any_present)


#: rows that usually show which columns have values
_GLANCE = 1000


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns with no present value.  Some first rows settle most
    columns; only those without a value there are counted over the table."""
    def present(rows: DataFrame, fields: list) -> set[str]:
        counts = rows.agg(*[F.count_if(~missing(F.col(f"`{f.name}`"), f.dataType)) for f in fields]).first()
        return {f.name for f, n in zip(fields, counts) if n}

    fields = df.schema.fields
    found = present(df.limit(_GLANCE), fields) if fields else set()
    rest = [f for f in fields if f.name not in found]
    if rest:
        found |= present(df.select(*[f"`{f.name}`" for f in rest]), rest)
    return df.select(*[f"`{f.name}`" for f in fields if f.name in found])


def normalize_loaded(df: DataFrame) -> DataFrame:
    """B1: A4, then B2, then B4 + B5."""
    out = expand_single_container(df)
    out = promote_header_row(out)
    return drop_empty_columns(drop_empty_rows(out))
