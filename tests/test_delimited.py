"""Folders of delimited files that differ in header, encoding and title lines; bounded heads."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from sifter.sources import headers, heads, readers


def _folder(tmp_dir, **files):
    d = os.path.join(tmp_dir, "in")
    os.makedirs(d)
    for name, data in files.items():
        with open(os.path.join(d, name.replace("__", " ") + ".csv"), "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())
    return d


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_columns_follow_each_files_header(spark, tmp_dir):
    d = _folder(tmp_dir, a="id,time,v\n1,2020-01-01,5.5\n", b="v,id,time\n7,2,2020-01-02\n", c="time,extra,id\n2020-01-03,x,3\n")
    df = readers.read_csv(spark, d)
    assert dict(df.dtypes) == {"id": "int", "time": "date", "v": "double", "extra": "string"}
    day = datetime.date
    assert _rows(df, "id", "time", "v", "extra") == [(1, day(2020, 1, 1), 5.5, None), (2, day(2020, 1, 2), 7.0, None), (3, day(2020, 1, 3), None, "x")]


def test_one_type_over_all_encodings_and_no_setting_changed(spark, tmp_dir):
    d = _folder(tmp_dir, a="x,y\n5,ü\n", b="x,y\ncafé €,2\n".encode("cp1252"), c=b"x,y\n7,A\x81\x80\n")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.legacy.javaCharsets", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    df = readers.read_csv(spark, d)
    assert dict(df.dtypes) == {"x": "string", "y": "string"}
    assert _rows(df, "x", "y") == [("5", "ü"), ("7", "A\x81\x80"), ("café €", "2")]
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_types_nulls_blank_and_repeated_names(spark, tmp_dir):
    d = _folder(tmp_dir, a__b="﻿n, N ,,t,ok,big\n1,a,z,2024-01-02 03:04:05,true,3000000000\n,,,2024-01-02,FALSE,1\n\n", empty="", only="n,N,,t,ok,big\n")
    df = readers.read_csv(spark, d)
    assert dict(df.dtypes) == {"n": "int", "N_2": "string", "_c2": "string", "t": "timestamp", "ok": "boolean", "big": "bigint"}
    assert df.count() == 2 and df.where("n is null and N_2 is null and not ok").count() == 1
    raw = readers.read_csv(spark, os.path.join(d, "a b.csv"), header=False, infer_schema=False)
    assert raw.count() == 3 and raw.columns == [f"_c{i}" for i in range(6)]


def test_a_folder_without_rows(spark, tmp_dir):
    assert readers.read_csv(spark, _folder(tmp_dir, a="")).count() == 0
    df = readers.read_csv(spark, _folder(tmp_dir + "/x", a="p,q\n"))
    assert df.columns == ["p", "q"] and df.count() == 0


def test_headers_with_quotes_and_line_breaks_and_names_with_wildcards(spark, tmp_dir):
    d = _folder(tmp_dir, **{"a[1]": '"long\nname","say ""x"", y"\n1,2\n', "b*": '"say ""x"", y","long\nname"\n3,4\n'})
    assert _rows(readers.read_csv(spark, d), "`long\nname`", '`say "x", y`') == [(1, 2), (4, 3)]


def test_each_file_loses_its_own_title_and_header(spark, tmp_dir):
    d = _folder(tmp_dir, a="Report of May,,\n,,\nEmployee ID,Full Name,Amount\n1,Ann,5\n", b="Amount,Employee ID,Full Name\n6,2,Bo\n", c=",,\nReport,,\nEmployee ID,Full Name,Amount\n3,Cy,7\n4,Di,8\n")
    raw = readers.read_csv(spark, d, header=False)
    out = readers.normalize_loaded(raw)
    assert sorted(out.columns) == ["Amount", "Employee ID", "Full Name"]
    assert _rows(out, "`Employee ID`", "`Full Name`", "Amount") == [("1", "Ann", "5"), ("2", "Bo", "6"), ("3", "Cy", "7"), ("4", "Di", "8")]
    plain = readers.normalize_loaded(readers.read_csv(spark, _folder(tmp_dir + "/y", a="1,2\n3,4\n"), header=False))
    assert plain.columns == ["_c0", "_c1"] and plain.count() == 2


def test_files_without_a_header_row_keep_their_rows(spark, tmp_dir):
    d = _folder(tmp_dir, a="Name,Date\nx,y\n", b="1,\n,2\n")
    out = headers.promote_header_row(readers.read_csv(spark, d, header=False, infer_schema=False))
    assert out.columns == ["Name", "Date", "_c0", "_c1"]
    assert _rows(out, "*") == sorted([("x", "y", None, None), (None, None, "1", None), (None, None, None, "2")], key=str)


def test_header_scores(spark):
    rows = [("Title", None, None), ("a", "A", None), ("x", " ", "y"), ("Alpha", "Beta", "Gamma"), ("Full Name", "When", "Hire Date"), ("id", "dates", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, `_c0` string, `_c1` string, `_c2` string")
    got = [r[0] for r in df.orderBy("k").select(headers.header_score(df.schema.fields[1:])).collect()]
    assert got == [None, None, None, 3, 9, 8]
    out = headers.promote_header_row(df, order="k")
    assert out.columns == ["Full Name", "When", "Hire Date", "k"] and [r["k"] for r in out.collect()] == [5]
    late = spark.createDataFrame([(None, 1.0)] * 10 + [("Name", None)], "`_c0` string, `_c1` double").coalesce(1)
    assert headers.promote_header_row(late).columns == ["_c0", "_c1"]  # beyond the tenth row
    assert headers.clean_headers(["a", "a", "a_2", 0, " "]) == ["a", "a_2", "a_2_2", "0", "column_5"]


def test_a_large_file_is_sniffed_without_reading_it(spark, tmp_dir):
    d = _folder(tmp_dir, small="a\tb\n", none="")
    with open(os.path.join(d, "large.csv"), "wb") as f:
        block = b"id,name,amount\n" + b"1234567,some name,12.50\n" * 700_000
        for _ in range(16):
            f.write(block)
    size = os.path.getsize(os.path.join(d, "large.csv"))
    stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    read = lambda: sum(s.getBytesRead() for s in stats.getAllStatistics())
    before, t0 = read(), time.time()
    got = {os.path.basename(r["path"]): r["format"] for r in readers.detect_formats(spark, d).collect()}
    assert got == {"small.csv": "tsv", "large.csv": "csv"}
    assert size > 250 << 20 and read() - before < 1 << 20 and time.time() - t0 < 60
    first = {f.rsplit("/", 1)[1]: head for f, head in heads.first_lines(spark, d, heads.first_record)}
    assert first == {"small.csv": b"a\tb", "large.csv": b"id,name,amount"}
    for p in os.listdir(d):  # a quarter of a gigabyte
        open(os.path.join(d, p), "wb").close()


@pytest.mark.parametrize("data,want", [(b"ab\r\n[", "text"), (b"\n\n[1]", "json"), (b"PK,x", "csv"), (b"PAR1\x00\x00", "parquet"), (b"{", "json"), (b"x\ty,z", "csv")])
def test_openings(spark, tmp_dir, data, want):
    path = os.path.join(tmp_dir, "f.csv")
    with open(path, "wb") as f:
        f.write(data)
    assert readers.detect_format(spark, path) == want
