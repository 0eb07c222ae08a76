"""Secret scans with structural confirmation.

Base kinds (leftmost, non-overlapping per kind; failing matches are dropped,
spans are of the whole match):

* ``assign``: a credential name, an assignment sign and a value of 12 or more characters
* ``access``: ``AKIA`` identifiers of 18 or more characters
* ``hex``: runs of 16 or more lower-case hex digits

The method adds what a decoder confirms:

* ``key``: a base64 or hex run (base64 may go on over lines, also over escaped
  line breaks) that decodes to a private key: DER whose nested lengths all add
  up and whose fields are those of a PKCS#1, PKCS#8 or EC key, or an OpenSSH
  container of length-prefixed fields.  The key's own lengths say where it
  ends, so what follows the run doesn't matter
* ``jwt``: three base64url parts whose header is a JSON object with an
  algorithm and whose payload is a JSON object

Offsets are code points, ends exclusive.  A null text counts as empty.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: kinds in the order in which equal starts are listed
KINDS = ("assign", "access", "hex", "key", "jwt")
BASE_KINDS = KINDS[:3]

# fixed values: the patterns of the base kinds
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the length may stand in the pattern
_NAMES = ("password", "passwd", "secret", "token", "api")

# a key starts its run, or follows an armour line or an escaped break
_START = r"(?:(?<![A-Za-z0-9+/_-]{0})|(?<=-----{0})|(?<=\\[nrt]{0}))"
_DER = re.compile(r"M(?:[A-H]|I(?=[E-T]))" + _START.format(".."))
_OPENSSH = re.compile("b3BlbnNzaC1rZXktdjEA" + _START.format("." * 20))
_LINE = re.compile(r"(?:[A-Za-z0-9+/_]|-(?!----))+")  # up to the dashes of an armour line
_BREAK = re.compile(r"[ \t]*(?:\r?\n|\\+r\\+n|\\+n)[ \t]*")
_LEAST = 22  # bytes
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d|6F70656E7373682D)[0-9A-Fa-f]{46,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _gather(text: str, at: int, n: int) -> tuple[str, int]:
    """Up to ``n`` base64 digits from ``at`` on over line breaks, and the end of the last."""
    parts, have, end = [], 0, at
    while have < n and (m := _LINE.match(text, at)):
        stop = min(m.end(), at + n - have)
        parts.append(text[at:stop])
        have, end = have + stop - at, stop
        if have == n or not (gap := _BREAK.match(text, end)):
            break
        at = gap.end()
    return "".join(parts), end


def _digits(n_bytes: int) -> int:
    return -(-n_bytes * 4 // 3)


def _unbase64(body: str) -> bytes:
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if "-" in body or "_" in body else None, validate=True)


def _head(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, size, where the content starts) of the field at ``at``."""
    if at + 2 > len(data):
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size == 0x80 or size > 0x84:
        return None
    if size > 0x80:
        n = size - 0x80
        size, at = int.from_bytes(data[at:at + n], "big"), at + n
    return tag, size, at


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the fields that fill ``data`` exactly, or None."""
    fields, at = [], 0
    while at < len(data):
        head = _head(data, at)
        if head is None or head[2] + head[1] > len(data):
            return None
        tag, size, at = head
        fields.append((tag, data[at:at + size]))
        at += size
    return fields


_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_der_key(data: bytes) -> bool:
    """A private key in PKCS#1, PKCS#8 or EC form; every length must fit."""
    outer = der_fields(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    parts = der_fields(outer[0][1])
    if not parts or parts[0][0] != _INTEGER or parts[0][1] not in (b"\x00", b"\x01"):
        return False
    tags = [t for t, _ in parts]
    if len(tags) >= 9 and all(t == _INTEGER for t in tags[:9]):
        return all(len(v) > 0 for _, v in parts[:9])
    if len(tags) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:
        algorithm = der_fields(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == _OID and der_fields(parts[2][1]) is not None
    return len(tags) >= 2 and tags[1] == _OCTETS and parts[0][1] == b"\x01" and len(parts[1][1]) in (28, 32, 48, 66)


def der_extent(data: bytes) -> int | None:
    """Bytes of the sequence that ``data`` begins, if a key's version number comes first in it."""
    outer = _head(data, 0)
    version = outer and _head(data, outer[2])
    if not version or outer[0] != _SEQUENCE or version[:2] != (_INTEGER, 1) or data[version[2]:version[2] + 1] not in (b"\x00", b"\x01"):
        return None
    return outer[2] + outer[1]


def openssh_extent(data: bytes) -> tuple[int, bool] | None:
    """Magic, three length-prefixed names, a key count and that many public
    parts and one private part: bytes up to the end of the last part, True; or
    if ``data`` stops before that is known, the bytes needed to go on, False."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return None
    at, left = len(magic), 3
    keys = None
    while True:
        if at + 4 > len(data):
            return at + 4, False
        size = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if left == 0 and keys is None:
            keys = size
            left = keys + 1
            if not 1 <= keys <= 64:
                return None
            continue
        at += size
        left -= 1
        if left == 0 and keys is not None:
            return at, True


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH container that fills ``data``."""
    return openssh_extent(data) == (len(data), True)


def _openssh_size(text: str, start: int, limit: int) -> tuple[int | None, int]:
    """Bytes of the container at ``start``; or None and, if its run is too short, the run's end."""
    want = 512
    while True:
        body, end = _gather(text, start, want)
        extent = openssh_extent(_unbase64(body))
        if extent is None or extent[1]:
            return extent and extent[0], 0
        if len(body) < want or start + _digits(extent[0]) > limit:
            return None, end if len(body) < want else 0
        want = max(2 * want, _digits(extent[0]))


def _base64_keys(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64; after a failed start the search goes on right behind it."""
    out = []
    for pattern, is_key in ((_DER, is_der_key), (_OPENSSH, is_openssh_key)):
        at, dry = 0, 0  # the run that ends at ``dry`` was too short once
        while m := pattern.search(text, at):
            start, at = m.start(), m.end()
            limit = dry if start < dry else len(text)
            if is_key is is_der_key:
                size = der_extent(_unbase64(_gather(text, start, 24)[0]))
            else:
                size, end = _openssh_size(text, start, limit)
                dry = max(dry, end)
            n = _digits(size or 0)
            if not size or size < _LEAST or start + n > limit:
                continue
            body, end = _gather(text, start, n)
            if len(body) < n:
                dry = end
            elif is_key(_unbase64(body)[:size]):
                for _ in range(-n % 4):
                    gap = _BREAK.match(text, end)
                    pad = gap.end() if gap else end
                    end = pad + 1 if text[pad:pad + 1] == "=" else end
                out.append(("key", start, end))
                at = end
    return out


def _hex_keys(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _HEX_ANY.finditer(text):
        data = bytes.fromhex(m[0][:len(m[0]) // 2 * 2])
        size = der_extent(data) or (openssh_extent(data) or (0, False))[0]
        if _LEAST <= size <= len(data) and (is_der_key(data[:size]) or is_openssh_key(data[:size])):
            out.append(("key", m.start(), m.start() + 2 * size))
    return out


def _json(part: str) -> dict | None:
    try:
        value = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """What decoding and parsing confirm."""
    out = _base64_keys(text) + _hex_keys(text)
    if "ey" in text:
        for m in _JWT.finditer(text):
            header = _json(m[1])
            if header and isinstance(header.get("alg"), str) and _json(m[2]) is not None and (m[3] or header["alg"].lower() == "none"):
                out.append(("jwt", *m.span()))
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind in the listed order."""
    text = text or ""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(col: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in scan(v.as_py())] for v in col], _SPAN)


def find_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``_spans``, row by row (nothing is shuffled)."""
    scanned = F.arrow_udf(_scan, "array<struct<kind:string,start:int,end:int>>")
    return docs.withColumn("_spans", scanned(F.col(text_col)))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
