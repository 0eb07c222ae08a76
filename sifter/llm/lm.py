"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of two orders with a uniform
floor: P(w | u) = a_b c(u w) / c(u) + b_b c(w) / N + g_b / (V + 1), where the
weights depend on the bucket b of the context's frequency (octaves of c(u)).
The weights are learned by expectation-maximisation: counts are taken from
nine parts of the training documents and the tokens of the tenth are the
held-out counts.  The final model uses the counts of all training documents.

How counts travel.  Documents are dealt into chunks of about
``chunk_bytes``.  A chunk sends its distinct words and word pairs, as sorted
64-bit hashes with counts, to the tasks that own the hash ranges; these add
up all chunks and answer every chunk with the totals, in the order in which
it asked.  One request carries a chunk's counts as well as its questions,
and a frequent word is one entry per chunk.  Nothing passes through the
driver but the sizes and the cells of the held-out statistics, whose number
is fixed by their grid.

Tokens are lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end per
text.  A null text counts as empty: one token, its end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sifter.llm.common import written
from sifter.llm.words import WHITE_SPACE, combine, hashed_words

_END, _BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
SCORED, TUNED, FITTED = 0, 1, 2  # roles of a document's tokens
BUCKETS = 40
_GRID = 8  # bins per octave of the held-out statistics
_BINS = 64 * _GRID
_START = (0.5, 0.4, 0.1)
_FLOOR = 1e-6  # least weight of the uniform part


class Chunk:
    """Tokens of some documents, with their distinct keys of both orders."""

    def __init__(self, texts: pa.Array):
        words, offsets = hashed_words(texts, WHITE_SPACE)
        n = len(offsets) - 1
        sizes = np.diff(offsets) + 1
        self.offsets = np.r_[0, np.cumsum(sizes)]
        ends = self.offsets[1:] - 1
        token = np.full(self.offsets[-1], _END, np.uint64)
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner] = words
        self.context = np.r_[_BEGIN, token[:-1]] if len(token) else token.copy()
        self.context[self.offsets[:-1][:n]] = _BEGIN
        self.first = np.zeros(len(token), bool)
        self.first[self.offsets[:-1][:n]] = True
        self.keys, self.slot, self.count = {}, {}, {}
        for order, key in ((1, token), (2, combine([self.context, token], 2))):
            self.keys[order], self.slot[order], count = np.unique(key, return_inverse=True, return_counts=True)
            self.count[order] = count.astype(np.int64)
        # a context is the word before, or the beginning, of which there are as many as ends
        before = np.searchsorted(self.keys[1], np.where(self.first, _END, self.context))
        self.before = np.minimum(before, max(len(self.keys[1]) - 1, 0))

    def estimates(self, totals: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(u w), c(u) and c(w) of every token."""
        single, pair = totals[1], totals[2]
        return pair[self.slot[2]], single[self.before], single[self.slot[1]]


def bucket(context_count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context_count + 1).astype(np.int64), BUCKETS - 1)


_REQUEST = "part int, order int, chunk long, role int, keys binary, counts binary"
_ANSWER = "chunk long, order int, part int, totals binary, fitted binary, n_tokens long, n_types long"


def _pack(a: np.ndarray) -> bytes:
    """Counts as bytes, in the narrowest width that holds them."""
    width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << (8 * w - 1) or w == 8)
    return bytes([width]) + a.astype(f"<i{width}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64)


def _requests(parts: int):
    shift = np.uint64(64 - int(math.log2(parts)))
    schema = pa.schema([("part", pa.int32()), ("order", pa.int32()), ("chunk", pa.int64()), ("role", pa.int32()),
                        ("keys", pa.binary()), ("counts", pa.binary())])

    def ask(table: pa.Table) -> pa.Table:
        role, number = table["role"][0].as_py(), table["chunk"][0].as_py()
        chunk = Chunk(table["text"].combine_chunks())
        rows = []
        for order in (1, 2):
            keys, count = chunk.keys[order], chunk.count[order]
            owner = (keys >> shift).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
            cut = np.searchsorted(owner, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                a, b = cut[p], cut[p + 1]
                rows.append({"part": int(p), "order": order, "chunk": number, "role": role,
                             "keys": _short(keys[a:b], parts), "counts": _pack(count[a:b])})
        return pa.Table.from_pylist(rows, schema)

    return ask


def _short(keys: np.ndarray, parts: int) -> bytes:
    """The low 56 bits of each key; its owner knows eight bits or more besides."""
    wide = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, :7] if parts >= 256 else wide).tobytes()


def _long(data: bytes, parts: int) -> np.ndarray:
    if parts < 256:
        return np.frombuffer(data, "<u8")
    raw = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return np.ascontiguousarray(np.concatenate([raw, np.zeros((len(raw), 1), np.uint8)], axis=1)).view("<u8").ravel()


def _answers(parts: int):
    kinds = {"chunk": pa.int64(), "order": pa.int32(), "part": pa.int32(), "totals": pa.binary(), "fitted": pa.binary(),
             "n_tokens": pa.int64(), "n_types": pa.int64()}
    schema = pa.schema(list(kinds.items()))

    def add_up(table: pa.Table) -> pa.Table:
        part, order = table["part"][0].as_py(), table["order"][0].as_py()
        roles = table["role"].to_pylist()
        asked = [_long(k, parts) for k in table["keys"].to_pylist()]
        sizes = [len(k) for k in asked]
        types, slot = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([_unpack(c) for c in table["counts"].to_pylist()])
        role = np.repeat(roles, sizes)
        fitted = np.bincount(slot, np.where(role == FITTED, counts, 0), len(types)).astype(np.int64)
        total = fitted + np.bincount(slot, np.where(role == TUNED, counts, 0), len(types)).astype(np.int64)
        rows, at = [], 0
        for chunk, r, n in zip(table["chunk"].to_pylist(), roles, sizes):
            s, at = slot[at:at + n], at + n
            rows.append({"chunk": chunk, "order": order, "part": part, "totals": _pack(total[s]),
                         "fitted": _pack(fitted[s]) if r == TUNED else None, "n_tokens": None, "n_types": None})
        if order == 1:  # the sizes of the training text travel as a row of no chunk
            for kind, c in ((-1, total), (-2, fitted)):
                rows.append({"chunk": kind, "order": order, "part": part, "totals": None, "fitted": None,
                             "n_tokens": int(c.sum()), "n_types": int((c > 0).sum())})
        return pa.Table.from_pylist(rows, schema)

    return add_up


def _totals(answers: pa.Table, column: str) -> dict[int, np.ndarray]:
    """The answers of all hash ranges, joined in the order of the keys."""
    out = {1: np.zeros(0, np.int64), 2: np.zeros(0, np.int64)}
    rows = sorted(zip(answers["order"].to_pylist(), answers["part"].to_pylist(), answers[column].to_pylist()), key=lambda x: x[:2])
    for order in out:
        got = [_unpack(x[2]) for x in rows if x[0] == order]
        if got:
            out[order] = np.concatenate(got)
    return out


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else the number of its bin on a log scale."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + np.round(-np.log2(p) * _GRID), 1, _BINS - 1), 0).astype(np.int64)


def _held_out(n_tokens: int):
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def count(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_pylist([], schema)
        chunk = Chunk(docs["text"].combine_chunks())
        pair, before, single = chunk.estimates(_totals(answers, "fitted"))
        cell = (bucket(before) * _BINS + _bin(pair / np.maximum(before, 1))) * _BINS + _bin(single / max(n_tokens, 1))
        cells, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": cells.astype(np.int64), "n": n.astype(np.int64)}, schema=schema)

    return count


def learn_weights(cells: np.ndarray, n: np.ndarray, n_types: int, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation per bucket: weights (BUCKETS, 3).  A bucket
    without held-out tokens has the weights of the nearest that has some."""
    weights = np.tile(np.array(_START), (BUCKETS, 1))
    if not len(cells):
        return weights
    b, rest = np.divmod(cells, _BINS * _BINS)
    p2, p1 = (np.where(k > 0, 2.0 ** (-(k - 1) / _GRID), 0.0) for k in np.divmod(rest, _BINS))
    part = np.stack([p2, p1, np.full(len(cells), 1 / (n_types + 1))], axis=1)
    seen = np.bincount(b, n, BUCKETS) > 0
    for _ in range(rounds):
        share = weights[b] * part
        share *= (n / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], axis=1)
        total = new.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, new / np.maximum(total, 1e-300), weights)
    weights[:, 2] = np.maximum(weights[:, 2], _FLOOR)
    weights /= weights.sum(axis=1, keepdims=True)
    near = np.flatnonzero(seen)
    return weights[near[np.abs(np.arange(BUCKETS)[:, None] - near[None, :]).argmin(axis=1)]]


def _scores(weights: np.ndarray, n_tokens: int, n_types: int, keep: pa.Schema):
    schema = pa.schema([*keep, ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_pylist([], schema)
        chunk = Chunk(docs["text"].combine_chunks())
        pair, before, single = chunk.estimates(_totals(answers, "totals"))
        w = weights[bucket(before)]
        p = w[:, 0] * (pair / np.maximum(before, 1)) + w[:, 1] * (single / max(n_tokens, 1)) + w[:, 2] / (n_types + 1)
        base = (single + 0.1) / (n_tokens + 0.1 * (n_types + 1))
        at = chunk.offsets[:-1]
        columns = [np.diff(chunk.offsets), np.add.reduceat((single > 0).astype(np.int64), at),
                   np.add.reduceat(np.log10(base), at), np.add.reduceat(np.log10(p), at)]
        return pa.table([docs[f.name].cast(f.type) for f in keep] + [pa.array(c) for c in columns], schema=schema)

    return score


def score_texts(docs: DataFrame, role: Column, *, id_col: str = "doc_id", text_col: str = "text",
                chunk_bytes: int = 12 << 20, keys_per_part: int = 400_000) -> DataFrame:
    """(``id_col``, n_tokens, n_known, train_tokens, base_score, score) per row.

    ``role`` is SCORED, TUNED or FITTED per row: tuned and fitted rows are the
    training text, tuned ones the held-out part for the weights.  Equal rows
    get equal scores; an empty table gives no row; without training text all
    counts are 0.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       role.cast("int").alias("role"), F.xxhash64(id_col, text_col).alias("h"))
    sizes = {r["role"]: r["b"] for r in docs.select(role.cast("int").alias("role"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).alias("b"))
             .groupBy("role").agg(F.sum("b").alias("b")).collect()}
    chunks = {k: max(1, math.ceil(b / chunk_bytes)) for k, b in sizes.items()}
    n = F.coalesce(F.create_map(*[F.lit(x) for k, v in chunks.items() for x in (k, v)] or [F.lit(0), F.lit(1)])[F.col("role")], F.lit(1))
    rows = rows.withColumn("chunk", (F.col("role") * F.lit(1 << 32) + F.pmod("h", n)).cast("long")).drop("h")
    parts = 1 << max(4, math.ceil(math.log2(max(1, sum(sizes.values()) / 5 / keys_per_part))))

    asked = rows.select("chunk", "role", "text").groupBy("chunk").applyInArrow(_requests(parts), _REQUEST)
    answers = written(asked.groupBy("part", "order").applyInArrow(_answers(parts), _ANSWER), "answers")
    stats = {r["chunk"]: r for r in answers.where("chunk < 0").groupBy("chunk")
             .agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).collect()}
    (n_all, v_all), (n_fit, v_fit) = ((stats[k]["n"], stats[k]["v"]) if k in stats else (0, 0) for k in (-1, -2))

    tuned = rows.where(F.col("role") == TUNED).select("chunk", "text").groupBy("chunk").cogroup(
        answers.where(F.col("fitted").isNotNull()).select("chunk", "order", "part", "fitted").groupBy("chunk"))
    cells = tuned.applyInArrow(_held_out(n_fit), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([c["cell"] for c in cells], np.int64), np.array([c["n"] for c in cells], np.float64), v_fit)

    arrow_id = _arrow_type(docs, id_col)
    scored = rows.select("chunk", "doc", "text").groupBy("chunk").cogroup(
        answers.where("chunk >= 0").select("chunk", "order", "part", "totals").groupBy("chunk"))
    out = scored.applyInArrow(_scores(weights, n_all, v_all, pa.schema([("doc", arrow_id)])),
                              f"doc {id_type.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc").alias(id_col), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[name].dataType)
