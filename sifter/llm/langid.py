"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent, with calibrated rejection.

A text's subwords are the character n-grams of its lower-cased words (a
blank marks a word's ends), hashed to a fixed number of buckets.  The text
vector is the mean of its buckets' embeddings and a softmax layer over it
gives the languages.  As mean and layer are linear, the trained model is one
table of scores per (bucket, language), so a whole text of any length is
scored with one pass of sums.

A temperature, fitted on a calibration part of the labelled rows, turns the
softmax into a probability.  As a softmax knows no "none of these", a second
number says how typical a text is of the learned languages together: the mean
log frequency of its buckets, as deviations from the calibration segments' mean
(a deviation has a part per document and a part that falls with the length).

A text is rejected if it has no letter or if its probability or its typicality
is below what all but ``reject_share`` of the calibration segments reach; the
probability's level is ``margin`` times that, as clean texts of two languages lie
there.  A calibration part of fewer than 1 / ``reject_share`` segments doesn't
show that quantile: then both start from the lowest segment, and the deviation
is carried on by Chebyshev's rule (shares fall with its square).
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sifter.llm.common import small_batches

UNKNOWN = "und"
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """About ``sample_rows`` + ``calibration_rows`` labelled rows, and of each
    language about ``language_rows`` (or all it has, if fewer), drawn by a hash
    of id and text, and one segment of at most ``segment_chars`` characters of
    each, at a hashed position, are the training data.  ``calibration_share`` of
    ``sample_rows`` and all rows beyond those are the calibration part, but
    ``language_rows`` of each language train, less their calibration share."""

    sample_rows: int = 4000
    language_rows: int = 200
    segment_chars: int = 1000
    buckets: int = 1 << 16
    width: int = 16
    orders: tuple[int, ...] = (1, 2, 3)
    epochs: int = 4
    rate: float = 0.5
    calibration_share: float = 0.2
    calibration_rows: int = 4000
    reject_share: float = 0.0005
    margin: float = 0.9
    least_spread: float = 0.01  # variance of a document's mean log frequency, at least
    seed: int = 11


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters (and count towards words)."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def subwords(text: str, settings: Settings) -> tuple[np.ndarray, bool]:
    """Bucket numbers of a piece of text and whether it has a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[points]
    if not inside.any():
        return np.zeros(0, np.int64), False
    code = np.where(inside, points, 32).astype(_U)
    code, inside = np.r_[_U(32), code, _U(32)], np.r_[False, inside, False]
    gap = np.cumsum(~inside)
    out = []
    h = np.zeros(len(code), _U)
    for n in range(1, max(settings.orders) + 1):
        h = (h[:len(code) - n + 1] * _U(0x100000001B3) + code[n - 1:]) & _U(0xFFFFFFFFFFFF)
        if n not in settings.orders:
            continue
        m = len(h)
        if n == 1:
            good = inside
        elif n == 2:
            good = inside[:m] | inside[1:]
        else:  # blanks only at the ends, at least one letter between
            good = gap[n - 2:n - 2 + m] == gap[:m]
        mixed = (h[good] + _U(n)) * _U(0x9E3779B97F4A7C15)
        out.append(((mixed >> _U(20)) % _U(settings.buckets)).astype(np.int64))
    return np.concatenate(out), True


class Model:
    """scores[bucket, language], with log frequencies as a last column; bias,
    temperature, and the levels of probability and typicality."""

    def __init__(self, langs: list[str], settings: Settings):
        self.langs, self.settings = langs, settings
        self.scores = np.zeros((settings.buckets, len(langs) + 1), np.float32)
        self.bias = np.zeros(len(langs))
        self.temperature, self.level = 1.0, 0.0
        self.mean, self.spread, self.floor = 0.0, (settings.least_spread, 0.0), -math.inf

    def _means(self, text: str, piece: int = 1 << 18) -> tuple[np.ndarray, int] | None:
        """Mean scores over all subwords and their number; a long text is summed piece by piece."""
        total, count = np.zeros(len(self.langs) + 1), 0
        for at in range(0, len(text), piece):
            part = text[max(0, at - 3):at + piece]
            buckets, any_letter = subwords(part, self.settings)
            if any_letter and len(buckets):
                total += self.scores[buckets].sum(axis=0, dtype=np.float64)
                count += len(buckets)
        return (total / count, count) if count else None

    def deviation(self, typical: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Mean log frequencies as standard deviations from the calibration mean."""
        return (typical - self.mean) / np.sqrt(self.spread[0] + self.spread[1] / count)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, accepted); ``und``, 0, false without letters."""
        means = self._means(text) if text and self.langs else None
        if means is None:
            return UNKNOWN, 0.0, False
        p = _softmax((means[0][:-1] + self.bias)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.level and self.deviation(means[0][-1], means[1]) >= self.floor)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], settings: Settings) -> Model:
    """Fit on a bounded list of segments.  With one language there is nothing
    to separate: its probability is 1, and only typicality rejects."""
    langs = sorted(set(labels))
    model = Model(langs, settings)
    rng = np.random.default_rng(settings.seed)
    rows = [(b, langs.index(y)) for t, y in zip(texts, labels) for b, any_letter in [subwords(t, settings)] if any_letter]
    if not rows:
        return model
    rng.shuffle(rows)
    train_share = 1 - settings.calibration_share
    share = min(train_share, settings.sample_rows * train_share / len(rows))
    size = np.bincount([y for _, y in rows], minlength=len(langs))
    quota = np.ceil(np.maximum(size * share, np.minimum(size, settings.language_rows) * train_share))
    held, used, taken = [], [], np.zeros(len(langs))
    for row in rows:
        taken[row[1]] += 1
        (used if taken[row[1]] <= quota[row[1]] else held).append(row)
    held = held or rows
    if len(langs) > 1:
        model.scores[:, :-1], model.bias = _fit(used, len(langs), rng, settings)
    seen = np.full((settings.buckets, len(langs)), 0.5)
    for buckets, y in used:
        np.add.at(seen[:, y], buckets, 1)
    model.scores[:, -1] = np.log((seen / seen.sum(axis=0)).mean(axis=1))
    _calibrate(model, held)
    return model


def _fit(used: list[tuple[np.ndarray, int]], n_langs: int, rng: np.random.Generator, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Scores and bias by stochastic gradient descent."""
    share = np.bincount([y for _, y in used], minlength=n_langs).astype(float)
    weight = np.sqrt(share.max(initial=1.0) / np.maximum(share, 1))  # rare languages count for more
    embed = rng.uniform(-1, 1, (settings.buckets, settings.width)) / settings.width
    layer, bias = np.zeros((settings.width, n_langs)), np.zeros(n_langs)
    steps, done = settings.epochs * len(used), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(used)):
            buckets, y = used[i]
            rate = settings.rate * (1 - done / steps)
            done += 1
            vec = embed[buckets].mean(axis=0)
            grad = _softmax((vec @ layer + bias)[None, :])[0]
            grad[y] -= 1
            grad *= weight[y]
            back = layer @ grad
            layer -= rate * np.outer(vec, grad)
            bias -= rate * 0.1 * grad
            uniq, times = np.unique(buckets, return_counts=True)
            embed[uniq] -= (rate * times / len(buckets))[:, None] * back * settings.width
    return (embed @ layer).astype(np.float32), bias


def _calibrate(model: Model, held: list[tuple[np.ndarray, int]]) -> None:
    """Temperature, spread and both levels from the calibration part."""
    settings = model.settings
    means = np.array([model.scores[b].mean(axis=0) for b, _ in held], float)
    count = np.array([len(b) for b, _ in held], float)
    truth = np.array([y for _, y in held])
    logits = means[:, :-1] + model.bias
    grid = np.geomspace(0.02, 50, 120)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-300)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    model.mean = float(np.average(means[:, -1], weights=count))
    parts = np.linalg.lstsq(np.c_[np.ones(len(count)), 1 / count], (means[:, -1] - model.mean) ** 2, rcond=None)[0]
    model.spread = max(settings.least_spread, float(parts[0])), max(0.0, float(parts[1]))
    reached = np.sort(_softmax(logits / model.temperature).max(axis=1))
    deviation = np.sort(model.deviation(means[:, -1], count))
    shown = settings.reject_share * len(held)
    model.level, model.floor = settings.margin * float(reached[int(shown)]), float(deviation[int(shown)])
    if shown < 1:
        model.floor = min(model.floor, -1.0) / math.sqrt(shown)


def learn(docs: DataFrame, usable: Column, settings: Settings = Settings(), *, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the bounded sample of the rows that ``usable`` admits and that
    have a text and a language.  Rows of each language are counted first, so a
    rare one is learned at every size of the table."""
    size = F.lit(settings.segment_chars)
    n_pieces = F.greatest(F.lit(1), F.floor(F.length(text_col) / size).cast("int"))
    turn = F.pmod(F.xxhash64(F.lit(settings.seed + 1), id_col), n_pieces).cast("int")
    lang = F.col(lang_col).cast("string")
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(lang.alias("y")).count().collect()  # one row per language
    if not counts:
        return train([], [], settings)
    share = (settings.sample_rows + settings.calibration_rows) / sum(r["count"] for r in counts)
    below = {r["y"]: math.ceil(min(1.0, max(share, settings.language_rows / r["count"])) * (1 << 30)) for r in counts}
    h = F.xxhash64(F.lit(settings.seed), id_col, text_col)
    limits = F.create_map(*[F.lit(v) for pair in below.items() for v in pair])
    wanted = sum(math.ceil(r["count"] * below[r["y"]] / (1 << 30)) for r in counts)
    picked = (labelled.where(F.pmod(h, F.lit(1 << 30)) < limits[lang])
              .select(h.alias("h"), lang.alias("y"), F.substring(F.col(text_col), turn * size + 1, size).alias("t"))
              .limit(2 * wanted).collect())  # repeated rows share a hash
    picked.sort(key=lambda r: (r["h"], r["y"], r["t"]))
    return train([r["t"] for r in picked], [r["y"] for r in picked], settings)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``_langid`` = struct(lang_pred, score,
    accepted).  A text that is null or has no letter gets ``und``, 0, false;
    if no language was learned every text does, as none can be trusted.
    The model's table (buckets x languages) is broadcast; its size is fixed
    by the settings and the languages of the sample."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def classify(col: pa.Array) -> pa.Array:
        m, found = shared.value, []
        for lo in range(0, len(col), 256):  # few texts at a time as Python's strings
            found += [m.judge(t) for t in col.slice(lo, 256).to_pylist()]
        lang, score, accepted = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                                          names=["lang_pred", "score", "accepted"])

    return docs.withColumn("_langid", classify(F.col(text_col)))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))
