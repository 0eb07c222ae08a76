"""Workbook (XLSX) reader as a folder job.

``binaryFile`` lists the workbooks; ``mapInPandas`` opens one workbook per
row with the standard library (zip + XML) and emits its first sheet as long
cells ``(path, row, col, name, head, value)``, where ``name`` is the header of
the cell's column in its own sheet's first row; Spark pivots the cells back
into a table by name, then types each column (numbers when every present value
parses).  No third-party spreadsheet library is needed.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET
from typing import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.cache import persisted
from sifter.functions.cols import INT_PATTERN, NUMBER_PATTERN
from sifter.sources.readers import clean_headers
from sifter.session import ship_package

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
CELL_SCHEMA = "path string, row int, col int, name string, head boolean, value string"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{NS['m']}}}t"))


def first_sheet_cells(content: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(row, col, value-as-text) of the first worksheet, 0-based."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        first = wb.find("m:sheets/m:sheet", NS)
        rid = first.get(f"{{{NS['r']}}}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.findall("rel:Relationship", NS)
                      if r.get("Id") == rid)
        sheet_path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
            shared = [_text(si) for si in sst.findall("m:si", NS)]
        sheet = ET.fromstring(z.read(sheet_path))
        for r_i, row in enumerate(sheet.iter(f"{{{NS['m']}}}row")):
            r_num = int(row.get("r")) - 1 if row.get("r") else r_i
            for c_i, cell in enumerate(row.findall("m:c", NS)):
                ref = cell.get("r")
                col = _col_index(ref) if ref else c_i
                kind = cell.get("t")
                v = cell.find("m:v", NS)
                if kind == "s" and v is not None:
                    val = shared[int(v.text)]
                elif kind == "inlineStr":
                    node = cell.find("m:is", NS)
                    val = _text(node) if node is not None else None
                elif kind == "b" and v is not None:
                    val = "True" if v.text == "1" else "False"
                else:
                    val = v.text if v is not None else None
                yield r_num, col, val


def _named_cells(path: str, content: bytes) -> pd.DataFrame:
    """The first sheet's cells, each with its column's name from the sheet's first row."""
    cells = list(first_sheet_cells(content))
    first = min((r for r, _, _ in cells), default=0)
    header = {c: v for r, c, v in cells if r == first}
    names = clean_headers([header.get(i) for i in range(max((c for _, c, _ in cells), default=-1) + 1)])
    return pd.DataFrame([(path, r, c, names[c], r == first, v) for r, c, v in cells],
                        columns=["path", "row", "col", "name", "head", "value"])


def _explode_workbooks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield _named_cells(path, bytes(content))


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Long cells of the first sheet of every workbook under ``path``."""
    ship_package(spark)  # workbooks are opened in Python workers
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_explode_workbooks, CELL_SCHEMA)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook -> one table (header = first row).

    Cells are pivoted by (path, row) under the names of their own workbook's
    first row, so the order of columns may differ between workbooks; a name
    that a workbook doesn't have is null there.  Columns come in the order of
    the first workbook (by path) that has them; a column without a header is
    ``column_{i}``.  A column whose present values all parse as integers
    becomes long, as numbers double, otherwise string."""
    cells = persisted(workbook_cells(spark, path))
    header = (cells.where(F.col("head") | F.col("value").isNotNull())
              .groupBy("name").agg(F.min(F.struct("path", "col")).alias("_at"))
              .orderBy("_at").collect())  # one row per distinct name
    names = [r["name"] for r in header]
    table = (cells.where(~F.col("head")).groupBy("path", "row").pivot("name", names).agg(F.first("value"))
             .toDF("path", "row", *[f"_{i}" for i in range(len(names))])
             .select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)]))
    # type each column from one aggregate over all of them
    checks = table.agg(*[F.count_if(F.col(f"`{n}`").isNotNull() & ~F.col(f"`{n}`").rlike(INT_PATTERN))
                         .alias(f"i{i}") for i, n in enumerate(names)],
                       *[F.count_if(F.col(f"`{n}`").isNotNull() & ~F.col(f"`{n}`").rlike(NUMBER_PATTERN))
                         .alias(f"d{i}") for i, n in enumerate(names)]).first()
    typed = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        if checks[f"i{i}"] == 0:
            typed.append(F.trim(c).try_cast("long").alias(n))
        elif checks[f"d{i}"] == 0:
            typed.append(F.trim(c).try_cast("double").alias(n))
        else:
            typed.append(c.alias(n))
    return table.select(*typed)
