"""64-bit hashes of the words of a text column, computed on whole buffers.

A word is a maximal run of bytes that are not separators.  Separators are
ASCII, so byte classes of UTF-8 text equal the character classes.  A word's
hash is a polynomial over random byte values modulo 2**64, read off prefix
sums and then mixed; two different words share a hash with a probability of
about 2**-64.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from sifter.llm.common import text_column

_PIECE = 1 << 20
_U = np.uint64


def _byte_class(pred) -> np.ndarray:
    return np.array([pred(b) for b in range(256)])


#: words ``[^\x20\x09-\x0D]+``
WHITE_SPACE = _byte_class(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
NOT_ALNUM = _byte_class(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@functools.cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240613)
    byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
    base = 0x9E3779B97F4A7C15 | 1
    power = np.full(size + 1, base, _U)
    power[0] = 1
    inverse = np.full(size + 1, pow(base, -1, 1 << 64), _U)
    inverse[0] = 1
    return byte, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@functools.cache
def _factors(n: int) -> np.ndarray:
    """Unrelated odd factors: any regular step between them would let
    different orders of the same words share a hash."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x632BE59BD9B4E019)) | _U(1)


def combine(columns: list[np.ndarray], salt: int) -> np.ndarray:
    """One hash per row of equally long columns; order matters."""
    acc = np.full(len(columns[0]), salt, _U)
    for c, f in zip(columns, _factors(len(columns))):
        acc = acc + c * f
    return mix(acc)


def hashed_words(col: pa.Array, is_sep: np.ndarray, piece: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column in order, and the n + 1 offsets
    of each text's words.  A-Z count as a-z.  ``piece`` bytes are worked on at a
    time (about 60 times as many are needed meanwhile)."""
    piece = piece or _PIECE
    flat, offsets = text_column(col)
    hashes, starts = [], []
    at, end = 0, len(flat)
    while at < end:
        to = min(at + piece, end)
        while to < end:  # a piece ends at a separator or where a text ends
            ahead = is_sep[_LOWER[flat[to:to + 4096]]]
            sep = int(ahead.argmax()) if ahead.any() else len(ahead)
            nxt = int(offsets[np.searchsorted(offsets, to)])
            to, stop = (nxt, True) if nxt <= to + sep else (to + sep, bool(ahead.any()))
            if stop:
                break
        low = _LOWER[flat[at:to]]
        word = ~is_sep[low]
        first = np.ones(len(low) + 1, bool)
        first[1:-1] = ~word[:-1]
        inner = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, to)] - at
        first[inner] = True
        last = first[1:].copy()
        last[:-1] |= ~word[1:]
        s = np.flatnonzero(word & first[:-1])
        e = np.flatnonzero(word & last) + 1
        size = max(piece, 1 << (len(low) - 1).bit_length())
        byte, power, inverse = _tables(size)
        total = np.zeros(len(low) + 1, _U)
        np.cumsum(byte[low] * power[:len(low)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s]))
        starts.append(s + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)
