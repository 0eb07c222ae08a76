"""Legacy archive converter: ARC files to WARC archives and back to rows.

An ARC file starts with a version block whose line, like every record's
header line, ends with the declared length of what follows.  Version 1 lines
have five fields, version 2 lines ten (result code, checksum, location,
offset and file name are new).  The converter reads the version from the
block, walks the records by their declared lengths and synthesises what WARC
asks for: a record id (a UUID hashed from URI, date, digest and place), an
ISO timestamp from the 14-digit one, the record type and SHA-1 digests.

Archives are written with Spark's text writer: a WARC record ends with two
line breaks, which is the writer's line separator, and record bytes pass
through unchanged.  So they lie in any file system that Spark writes, one
gzip file per task and at most ``records_per_file`` records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sifter.llm.common import written

#: fixed values: field names of the header lines by version
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "20240101000000"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes
    offset: int


def arc_bytes(name: str, version: int, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC file of (url, 14-digit date, content)."""
    def line(url: str, ip: str, date: str, kind: str, size: int, offset: int) -> bytes:
        v2 = f" 200 - - {offset} {name}" if version == 2 else ""
        return f"{url} {ip} {date} {kind}{v2} {size}\n".encode()

    block = f"{version} 0 sifter\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = bytearray(line(f"filedesc://{name}", "0.0.0.0", _DATE, "text/plain", len(block), 0) + block)
    for url, date, content in records:
        out += line(url, "0.0.0.0", date, "text/html", len(content), len(out)) + content + b"\n"
    return bytes(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file after its version block, by declared lengths.
    Raises ValueError at a header line or length that doesn't fit."""
    at, version = 0, 0
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        start, end = at, data.find(b"\n", at)
        head = data[at:end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r")
        size = head.rpartition(" ")[2]
        if end < 0 or not size.isdigit() or end + 1 + int(size) > len(data):
            raise ValueError(f"bad ARC header at offset {at}: {head[:80]!r}")
        content, at = data[end + 1:end + 1 + int(size)], end + 1 + int(size)
        if not version:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        names = ARC_FIELDS[version]
        values = head.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"bad ARC header at offset {start}: {head[:80]!r}")
        yield ArcRecord(dict(zip(names, values)), content, start)


def warc_date(arc_date: str) -> str:
    """ISO form of an ARC date; missing digits at the end are the earliest."""
    d = arc_date + "00000101000000"[len(arc_date):] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_RECORD = ("page_id long, uri string, ip string, warc_date string, record_id string, payload_digest string, "
           "payload_bytes long, block_digest string, head binary, payload binary")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20):
    """Record batches of about ``limit`` bytes of payload."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += 500 + len(row.get("payload") or row.get("archive") or b"")
        if size >= limit:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def to_arc(pages: DataFrame, *, archive_bytes: int = 2 << 20) -> DataFrame:
    """(name, archive) legacy archives of (page_id, url, html); versions 1 and 2
    alternate.  The page's id travels as a header of the HTTP response.  A
    null html is an empty payload, a null url is ``urn:none``."""
    schema = _schema("name string, archive binary")

    def build(batches):
        def archives():
            kept, size, turn = [], 0, 0
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    uri = "".join(c if c > " " else "%20" for c in url) if url else "urn:none"
                    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
                    head += [f"X-Page-Id: {page}"] * (page is not None)
                    kept.append((uri, _DATE, "\r\n".join(head).encode() + b"\r\n\r\n" + payload))
                    size += len(payload) + 300
                    if size >= archive_bytes:
                        yield {"name": (n := f"legacy-{turn}.arc"), "archive": arc_bytes(n, 1 + turn % 2, kept)}
                        kept, size, turn = [], 0, turn + 1
            if kept:
                yield {"name": (n := f"legacy-{turn}.arc"), "archive": arc_bytes(n, 1 + turn % 2, kept)}

        yield from _batches(archives(), schema)

    return pages.select("page_id", "url", "html").mapInArrow(build, "name string, archive binary")


def _records(data: bytes) -> Iterator[dict]:
    for r in read_arc(data):
        head, sep, payload = r.content.partition(b"\r\n\r\n")
        if not head.startswith(b"HTTP/") or not sep:
            head, sep, payload = b"", b"", r.content
        page = next((x[10:].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), None)
        digest = hashlib.sha1(payload).hexdigest()
        uri, date = r.fields["URL"], r.fields["Archive-date"]
        key = f"{uri} {date} {digest} {page!r} {r.offset}"
        yield {"page_id": int(page) if page is not None else None, "uri": uri, "ip": r.fields["IP-address"],
               "warc_date": warc_date(date), "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>",
               "payload_digest": digest, "payload_bytes": len(payload),
               "block_digest": hashlib.sha1(r.content).hexdigest(), "head": head + sep, "payload": payload}


def convert(archives: DataFrame) -> DataFrame:
    """Records of ARC files (column ``archive``), with synthesised fields."""
    schema = _schema(_RECORD)

    def parse(batches):
        for batch in batches:
            for value in batch.column(0):
                yield from _batches(_records(value.as_py()), schema)

    return archives.select("archive").mapInArrow(parse, _RECORD)


def mark_revisits(records: DataFrame, shared: DataFrame) -> DataFrame:
    """Add ``refers_to``: the page of the response that a revisit repeats.

    ``shared`` is (payload_digest, refers_to) of the payloads with several
    records, see :func:`shared_payloads`."""
    joined = records.join(shared, "payload_digest", "left")
    other = F.col("refers_to").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    return joined.withColumn("refers_to", F.when(other, F.col("refers_to")))


def shared_payloads(payloads: DataFrame, min_bytes: int) -> DataFrame:
    """(payload_digest, refers_to) of payloads of at least ``min_bytes`` with
    several records: the largest page id.  Grouped with partial sums, so a
    payload that a third of the pages share is one row per task."""
    return (payloads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
            .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))


def write_archives(records: DataFrame, path: str, *, records_per_file: int = 4096) -> None:
    """Write marked records as gzip WARC archives below ``path``."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    http = F.octet_length("head") > 0
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").when(http, "response").otherwise("resource")),
        ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("warc_date")), ("WARC-Target-URI", F.col("uri")),
        ("WARC-IP-Address", F.col("ip")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha1:"), F.col("block_digest")))),
        ("WARC-Profile", F.when(revisit, F.lit(_REVISIT))),
        ("X-Payload-Length", F.col("payload_bytes").cast("string")), ("X-Page-Id", F.col("page_id").cast("string")),
        ("X-Refers-To-Page", F.col("refers_to").cast("string")),
        ("Content-Type", F.when(http, "application/http; msgtype=response").otherwise("application/octet-stream")),
        ("Content-Length", F.octet_length(body).cast("string")),
    ]
    lines = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{n}: "), v) for n, v in fields])
    record = F.concat(F.concat(lines, F.lit("\r\n\r\n")).cast("binary"), body).cast("string")
    (records.select(record.alias("record")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of an uncompressed WARC stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name] = value.strip()
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield fields, block


_READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, "
         "uri string, warc_date string, stored_bytes long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``.  The digest of a
    stored payload is computed again and must be the declared one."""
    schema = _schema(_READ)

    def rows(content: bytes) -> Iterator[dict]:
        for fields, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content))):
            payload = block.partition(b"\r\n\r\n")[2] if fields["Content-Type"].startswith("application/http") else block
            kind, declared = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind != "revisit" and (hashlib.sha1(payload).hexdigest() != declared or len(payload) != int(fields["X-Payload-Length"])):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
            number = {n: int(fields[n]) if n in fields else None for n in ("X-Page-Id", "X-Refers-To-Page")}
            yield {"page_id": number["X-Page-Id"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": declared,
                   "record_type": kind, "refers_to": number["X-Refers-To-Page"], "record_id": fields["WARC-Record-ID"],
                   "uri": fields["WARC-Target-URI"], "warc_date": fields["WARC-Date"], "stored_bytes": len(payload)}

    def parse(batches):
        for batch in batches:
            for value in batch.column(0):
                yield from _batches(rows(value.as_py()), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, _READ)


def archive_pages(pages: DataFrame, path: str, *, min_bytes: int = 1000, records_per_file: int = 4096) -> None:
    """Pages to legacy archives, these converted, revisits marked, written.

    Of pages with equal payloads of ``min_bytes`` or more, those with the
    largest page id are responses, the others (also those without id) revisit
    them; shorter payloads are always responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    payloads = pages.select("page_id", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    shared = written(shared_payloads(payloads, min_bytes), "payloads")
    records = convert(to_arc(pages))
    write_archives(mark_revisits(records, shared), path, records_per_file=records_per_file)
