import json
import os

import pytest
from pyspark.sql import functions as F

from sifter.operators import reshape
from sifter.sources import readers, routing, store


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_csv_encodings(spark, tmp_dir):  # FX18, A1
    utf = _write(os.path.join(tmp_dir, "u.csv"), "name\nA B\n".encode("utf-8"))
    cp = _write(os.path.join(tmp_dir, "c.csv"), "name\nA B €\n".encode("cp1252"))
    lat = _write(os.path.join(tmp_dir, "l.csv"), b"name\nA\x81B\n")
    assert readers.read_csv(spark, utf).first()["name"] == "A B"
    assert readers.read_csv(spark, cp).first()["name"] == "A B €"
    assert readers.read_csv(spark, lat).first()["name"] == "A\x81B"
    enc = {os.path.basename(r["file"]): r["encoding"]
           for r in readers.detect_encodings(spark, tmp_dir + "/*.csv").collect()}
    assert enc == {"u.csv": "utf-8", "c.csv": "cp1252", "l.csv": "latin-1"}


def test_tsv_and_json(spark, tmp_dir):  # A2, A3, FX13
    tsv = _write(os.path.join(tmp_dir, "a.tsv"), b"customer_id\torder_date\tamount\n1\t2026-01-01\t2.5\n")
    df = readers.read_tsv(spark, tsv)
    assert df.columns == ["customer_id", "order_date", "amount"] and df.first()["amount"] == 2.5
    js = _write(os.path.join(tmp_dir, "c.json"), json.dumps(
        [{"customer_id": 1, "order_date": "2026-01-01", "amount": 3.0},
         {"customer_id": 2, "order_date": "2026-01-02", "amount": None}]).encode())
    assert readers.read_json(spark, js).count() == 2


def test_nested_json_container(spark, tmp_dir):  # FX16, A4
    js = _write(os.path.join(tmp_dir, "n.json"), json.dumps(
        {"transactions": [{"id": "TXN-001", "date": "2026-01-01", "amount": 5.0},
                          {"id": "TXN-002", "date": "2026-01-02", "amount": 6.0}]}).encode())
    df = readers.normalize_loaded(readers.read_json(spark, js))
    assert sorted(df.columns) == ["amount", "date", "id"]
    assert df.orderBy("id").first()["id"] == "TXN-001"


def test_embedded_header(spark):  # FX17, B2, B3
    rows = [("Employee report", None, None, None), (None, None, None, None),
            (None, "Employee ID", "Full Name", "Hire Date"), (None, "S1001", "John Smith", "2023-05-15")]
    df = spark.createDataFrame(rows, "`Unnamed: 0` string, `Unnamed: 1` string, "
                                     "`Unnamed: 2` string, `Unnamed: 3` string")
    out = readers.normalize_loaded(df)
    assert out.columns == ["Employee ID", "Full Name", "Hire Date"]
    assert out.first()["Employee ID"] == "S1001"
    assert readers.clean_headers([" a ", "", "a", None]) == ["a", "column_2", "a_2", "column_4"]


def test_drop_empty_axes(spark):  # B4, B5
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None)], "a double, b string")
    out = readers.drop_empty_columns(readers.drop_empty_rows(df))
    assert out.columns == ["a"] and out.count() == 1


def test_format_detection(spark, tmp_dir):  # A10, FX14
    _write(os.path.join(tmp_dir, "events.parquet"), b"timestamp,source,event_type\n2026,a,b\n")
    _write(os.path.join(tmp_dir, "x.json"), b'[{"a": 1}]')
    _write(os.path.join(tmp_dir, "t.txt"), b"a\tb\n1\t2\n")
    _write(os.path.join(tmp_dir, "p.txt"), b"plain words\n")
    spark.range(3).write.parquet(os.path.join(tmp_dir, "real"))
    got = {os.path.basename(r["path"]): r["format"]
           for r in readers.detect_formats(spark, tmp_dir + "/*.*").collect()}
    assert got["events.parquet"] == "csv" and got["x.json"] == "json"
    assert got["t.txt"] == "tsv" and got["p.txt"] == "text"
    real = [f for f in os.listdir(os.path.join(tmp_dir, "real")) if f.endswith(".parquet")][0]
    assert readers.detect_format(spark, os.path.join(tmp_dir, "real", real)) == "parquet"
    assert readers.detect_format(spark, "sql://db/dbo/t") == "sql"
    with pytest.raises(ValueError):
        readers.load(spark, os.path.join(tmp_dir, "p.txt"), "text")


def test_sql_path_rules():  # A7
    assert readers.parse_sql_path("sql://Northwind/dbo/Orders") == ("Northwind", "dbo", "Orders")
    for bad in ("sql://db/dbo", "sql://db/dbo/Or-ders", "db/dbo/t"):
        with pytest.raises(ValueError):
            readers.parse_sql_path(bad)


def test_routing(spark):  # A8, A12, A14
    assert routing.object_store_path("acct", "raw", "csv/a.csv") == \
        "abfss://raw@acct.dfs.core.windows.net/csv/a.csv"
    assert routing.format_from_suffix("a.xlsm") == "xlsx"
    assert routing.format_from_suffix("a.txt") == "csv"
    cfg = routing.StoreConfig(account="acct", container="c", path="p/x.json")
    assert routing.route("raw/csv/a.csv", None, cfg)[1] == "abfss://raw@acct.dfs.core.windows.net/csv/a.csv"
    assert routing.route("./local.csv", None, cfg) == (None, "./local.csv")
    assert routing.route(None, "cloud", cfg) == ("json", "abfss://c@acct.dfs.core.windows.net/p/x.json")
    with pytest.raises(ValueError):
        routing.route(None, "local", cfg)
    assert routing.route("sql://a/b/c") == ("sql", "sql://a/b/c")
    assert routing.route("/abs/a.csv", None, cfg)[1] == "/abs/a.csv"
    assert routing.route("s3a://b/a.csv", None, cfg)[1] == "s3a://b/a.csv"
    spec = {"source_type": "sql", "database": "shop", "schema": "dbo", "table": "Orders", "jdbc_url": "jdbc:x"}
    assert routing.dataset_metadata(spark, "orders", spec)["source_location"] == "sql://shop/dbo/Orders"
    assert routing.resolve_source(spec) == ("sql", "sql://shop/dbo/Orders", {"url": "jdbc:x"})
    meta2 = routing.dataset_metadata(spark, "x", {"source_type": "blob", "path": "c/p.csv"})
    assert meta2["source_name"] == "x" and meta2["source_location"] == "c/p.csv"
    assert routing.resolve_source({"path": "c/p.csv"}, cfg)[1] == "abfss://c@acct.dfs.core.windows.net/p.csv"
    with pytest.raises(ValueError):
        readers.load(spark, "sql://shop/dbo/Orders")  # no url


def test_json_lines_arrays_and_objects(spark, tmp_dir):  # A3
    for name, text, n in (("l", "\n".join('{"a": %d, "b": "{x}"}' % i for i in range(1000)) + "\n\n", 1000),
                          ("a", '[\n{"a": 1, "b": "x"},\n{"a": 2, "b": "y"}\n]', 2), ("o", '{\n"a": 1,\n"b": "x"\n}', 1),
                          ("one", '[{"a": 1, "b": "}"}, {"a": 2, "b": "{"}]', 2)):
        path = os.path.join(tmp_dir, f"{name}.json")
        _write(path, text.encode())
        assert readers.load(spark, path).select("a", "b").count() == n, name


def test_csv_quotes_and_long_first_lines(spark, tmp_dir):  # A1, A10
    path = os.path.join(tmp_dir, "q.csv")
    _write(path, b'name,amount\n"a ""b"", c",1\n"two\nlines",2\n')
    assert [tuple(r) for r in readers.read_csv(spark, path).orderBy("amount").collect()] == [('a "b", c', 1), ("two\nlines", 2)]
    long = os.path.join(tmp_dir, "long.csv")
    _write(long, b"x" * 6000 + b",y\n1,2\n")
    assert readers.detect_format(spark, long) == "csv" and readers.load(spark, long).count() == 1


def test_store_round_trip(spark, tmp_dir):  # FX8, A15-A20
    raw = spark.createDataFrame([("cust-001", "2026-03-15T12:00:00", 10.0, 2),
                                 ("cust-002", "2026-03-15T12:05:00", 25.0, 1)],
                                "cust_id string, event_time string, amount double, count long")
    c = reshape.adapt(raw)
    for fmt in ("json", "parquet"):
        path = os.path.join(tmp_dir, f"store_{fmt}")
        store.save(c, path, fmt)
        back = store.load(spark, path, fmt)
        got = sorted((r["entity_id"], r["timestamp"], r["features"]["amount"], r["features"]["count"])
                     for r in back.collect())
        assert got == [("cust-001", "2026-03-15T12:00:00", 10.0, 2),
                       ("cust-002", "2026-03-15T12:05:00", 25.0, 1)]
        store.reset(spark, path, fmt)
        assert store.load(spark, path, fmt).count() == 0
    assert store.load(spark, os.path.join(tmp_dir, "missing"), "json").count() == 0
    os.makedirs(os.path.join(tmp_dir, "odd"))
    _write(os.path.join(tmp_dir, "odd", "x.txt"), b"no parquet")
    with pytest.raises(Exception):
        store.load(spark, os.path.join(tmp_dir, "odd"), "parquet")
    with pytest.raises(ValueError):
        store.save(c, os.path.join(tmp_dir, "x"), "xml")
    assert store.metadata(c).first()["record_count"] == 2


def test_run_summary_files(spark, tmp_dir):  # A21, A22
    path = os.path.join(tmp_dir, "runs")
    assert store.last_run_summary(spark, path).first()["status"] == "no runs recorded"
    store.write_run_summary(spark, {"status": "SUCCESS", "records_ingested": 3}, path)
    assert store.last_run_summary(spark, path).first()["records_ingested"] == 3


def test_csv_folder_mixed_encodings(spark, tmp_dir):  # A1 on a folder
    d = os.path.join(tmp_dir, "mixed")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), "name,amount\nZoë,1\n".encode("utf-8"))
    _write(os.path.join(d, "b.csv"), "name,amount\nRené €,2\n".encode("cp1252"))
    _write(os.path.join(d, "c.csv"), "name,amount\nÁ,3\n".encode("utf-8"))  # 0xC3 0x81: valid UTF-8
    rows = sorted((r["name"], r["amount"]) for r in readers.read_csv(spark, d).collect())
    assert rows == [("René €", 2), ("Zoë", 1), ("Á", 3)]
