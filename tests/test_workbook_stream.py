import os
import zipfile

from pyspark.sql import functions as F

from sifter.operators import anomaly, reshape, validate
from sifter.sources import readers, workbook

WB = """<?xml version="1.0" encoding="UTF-8"?>
<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">
<sheets><sheet name="Staff" sheetId="1" r:id="rId1"/><sheet name="Other" sheetId="2" r:id="rId2"/></sheets></workbook>"""
RELS = """<?xml version="1.0" encoding="UTF-8"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId2" Type="worksheet" Target="worksheets/sheet2.xml"/>
<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>"""
SST = """<?xml version="1.0" encoding="UTF-8"?>
<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<si><t>Employee ID</t></si><si><t>Full Name</t></si><si><r><t>Sal</t></r><r><t>ary</t></r></si>
<si><t>S1001</t></si><si><t>John Smith</t></si><si><t>S1002</t></si></sst>"""
SHEET = """<?xml version="1.0" encoding="UTF-8"?>
<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>
<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2" t="s"><v>4</v></c><c r="C2"><v>52000</v></c></row>
<row r="3"><c r="A3" t="s"><v>5</v></c><c r="B3" t="inlineStr"><is><t>Ann Lee</t></is></c><c r="C3"><v>61000.5</v></c></row>
</sheetData></worksheet>"""
OTHER = """<?xml version="1.0" encoding="UTF-8"?>
<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>"""


def _xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", WB)
        z.writestr("xl/_rels/workbook.xml.rels", RELS)
        z.writestr("xl/sharedStrings.xml", SST)
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/sheet2.xml", OTHER)
    return path


def test_workbook_first_sheet(spark, tmp_dir):  # A6
    _xlsx(os.path.join(tmp_dir, "staff.xlsx"))
    df = workbook.read_workbooks(spark, tmp_dir)
    assert df.columns == ["Employee ID", "Full Name", "Salary"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("S1001", "John Smith", 52000.0), ("S1002", "Ann Lee", 61000.5)]
    fmt = readers.detect_formats(spark, tmp_dir).first()["format"]
    assert fmt == "excel"
    assert readers.load(spark, tmp_dir, "xlsx").count() == 2


def _book(path, rows):
    cell = lambda c, r, v: f'<c r="{"ABCD"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
    sheet = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
             + "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
             + "</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w") as z:
        for file, text in (("workbook.xml", WB), ("_rels/workbook.xml.rels", RELS), ("worksheets/sheet1.xml", sheet)):
            z.writestr(f"xl/{file}", text)


def test_workbooks_keep_their_own_headers(spark, tmp_dir):  # A6
    sheets = {"a.xlsx": [("id", "name"), ("1", "ann"), ("2", "bob")], "b.xlsx": [("name", "id", "city"), ("cy", "3", "Oslo")],
              "c.xlsx": [("city", None, "id", "id"), ("Rome", "x", "4", "5")]}
    for file, rows in sheets.items():
        _book(os.path.join(tmp_dir, file), rows)
    for parts in ("1b", "128m"):  # each workbook in its own task, or all in one
        with_parts = spark.newSession()
        with_parts.conf.set("spark.sql.files.maxPartitionBytes", parts)
        df = workbook.read_workbooks(with_parts, tmp_dir)
        assert df.columns == ["id", "name", "city", "column_2", "id_2"]
        assert sorted(map(tuple, df.collect())) == [(1, "ann", None, None, None), (2, "bob", None, None, None),
                                                    (3, "cy", "Oslo", None, None), (4, None, "Rome", "x", 5)]


def test_one_frame_per_workbook():
    import io

    import pandas as pd
    books = [_xlsx(io.BytesIO()).getvalue() for _ in range(3)]
    frames = list(workbook._explode_workbooks([pd.DataFrame({"path": list("abc"), "content": books})]))
    assert [set(f["path"]) for f in frames] == [{"a"}, {"b"}, {"c"}]


def test_stream_validate_and_flag(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.withColumnRenamed("ts", "event_time").repartition(3).write.parquet(src)
    raw = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    checked = validate.validate(reshape.adapt(raw))
    recs = reshape.first_numeric_value(checked).select("entity_id", "timestamp", "value", "status")
    flagged = anomaly.ThresholdModel(threshold=100.0).transform(recs)
    out = os.path.join(tmp_dir, "out")
    q = (flagged.writeStream.option("checkpointLocation", os.path.join(tmp_dir, "ckpt"))
         .trigger(availableNow=True).start(out))
    q.awaitTermination(120)
    res = spark.read.parquet(out)
    assert res.count() == ev.count()
    assert res.where("is_anomaly").count() == ev.where("value > 100").count()
    assert res.where("status = 'valid'").count() == ev.count()
