"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer network in numpy with temperature-calibrated probabilities.

Random indexing.  Every word (a run between white space, lower-cased; words
fall into a fixed number of hash classes) has a sparse random index vector of
+1 and -1 that follows from its hash.  Its context vector is the sum of the
index vectors of its neighbours over the whole corpus, which is a random
projection of the co-occurrence counts.  The sums are whole numbers, so they
don't depend on the order of the rows.  A word's vector is its context vector's
direction after the part that any word shares has been taken away.

Pooling.  A text's features are the mean and the spread of its words' vectors, the
mean likeness of neighbouring words' vectors and the number of words, all over
the whole text.

Network.  One hidden layer of tanh units and one logistic output, trained on a
bounded sample of labelled rows by stochastic gradient descent with momentum;
a temperature fitted on a calibration part of the sample turns the output into
a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sifter.llm.common import spans, text_column, written
from sifter.llm.jaccard import _SLOTS, _sliced
from sifter.llm.words import WHITE_SPACE, hashed_words, mix

_U = np.uint64
WIDTH = 32
CLASSES = _SLOTS // WIDTH
GRAIN = 4096


@dataclass(frozen=True)
class Settings:
    """At most about ``sample_rows`` labelled rows are drawn, and of each label
    about ``label_rows`` (or all it has, if fewer), by a hash of id and text;
    ``calibration_share`` of them fit the temperature."""

    sample_rows: int = 20_000
    label_rows: int = 5_000
    window: int = 2
    nonzero: int = 4
    hidden: int = 32
    epochs: int = 40
    batch: int = 64
    rate: float = 0.05
    momentum: float = 0.9
    decay: float = 1e-4
    calibration_share: float = 0.2
    seed: int = 17


# --- word vectors -------------------------------------------------------------------

def _classes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(20)).astype(np.int64) & (CLASSES - 1)


def index_vectors(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of every class's index vector."""
    h = mix(np.arange(1, CLASSES * settings.nonzero + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(settings.seed))
    h = h.reshape(CLASSES, settings.nonzero)
    return (h % _U(WIDTH)).astype(np.int64), np.where(h >> _U(63), 1, -1).astype(np.int64)


def _worded(col: pa.Array):
    """(first text, word classes, offsets) of bounded portions of a column; a
    text longer than a portion stands alone."""
    _, cut = text_column(col)
    for lo, hi in spans(cut):
        h, at = hashed_words(col.slice(lo, hi - lo), WHITE_SPACE)
        yield lo, _classes(h), at


def context_vectors(docs: DataFrame, settings: Settings, text_col: str = "text") -> np.ndarray:
    """CLASSES x WIDTH whole numbers: the neighbours' index vectors summed over
    the whole corpus.  Every task adds up one array of fixed size."""
    where, sign = index_vectors(settings)

    def count(batch, total):
        for _, c, at in _worded(batch.column(0)):
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for gap in range(1, settings.window + 1):
                same = np.flatnonzero(text[gap:] == text[:-gap])
                left, right = c[same], c[same + gap]
                for k in range(settings.nonzero):
                    for a, b in ((left, right), (right, left)):
                        total += np.bincount(a * WIDTH + where[b, k], weights=sign[b, k], minlength=_SLOTS).astype(np.int64)

    return _sliced(docs.select(text_col), count).reshape(CLASSES, WIDTH)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Directions of the context vectors, without what all words share: rows of
    length ``GRAIN`` (or 0 where a class never had a neighbour), rounded to whole
    numbers, so that sums over a text don't depend on their order."""
    size = np.linalg.norm(contexts, axis=1, keepdims=True)
    unit = contexts / np.maximum(size, 1e-12)
    used = size[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(axis=0)
    return np.rint(GRAIN * unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)).astype(np.int16)


# --- pooling ---------------------------------------------------------------------------

N_FEATURES = 2 * WIDTH + 3


def features(col: pa.Array, vectors: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """One row of features per text; null or blank texts have zeros."""
    out = np.zeros((len(col), N_FEATURES))
    for lo, c, at in _worded(col):
        n = len(at) - 1
        total, square, like = np.zeros((n, WIDTH)), np.zeros((n, WIDTH)), np.zeros(n)
        text = np.repeat(np.arange(n), np.diff(at))
        for p in range(0, len(c), piece):  # bounded gathers, also inside one long text
            v = vectors[c[p:p + piece + 1]].astype(np.float64)
            own, m = v[:piece], text[p:p + piece]
            first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
            total[m[first]] += np.add.reduceat(own, first, axis=0)
            square[m[first]] += np.add.reduceat(own * own, first, axis=0)
            beside = (v[:-1] * v[1:]).sum(axis=1) * (text[p:p + len(v) - 1] == text[p + 1:p + len(v)])
            like += np.bincount(text[p:p + len(beside)], weights=beside, minlength=n)
        words = np.diff(at)
        some = np.maximum(words, 1)[:, None]
        mean = total / some / GRAIN
        rows = out[lo:lo + n]
        rows[:, :WIDTH] = mean
        rows[:, WIDTH:2 * WIDTH] = np.sqrt(np.maximum(square / some / GRAIN ** 2 - mean ** 2, 0))
        rows[:, 2 * WIDTH] = like / np.maximum(words - 1, 1) / GRAIN ** 2
        rows[:, 2 * WIDTH + 1] = np.log1p(words)
        rows[:, 2 * WIDTH + 2] = words > 0
        rows[words == 0] = 0
    return out


# --- network ----------------------------------------------------------------------------

def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Network:
    """tanh layer and logistic output over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Network:
    """Fit on rows of features and labels 0 or 1.  Without rows every score is
    0.5; with one label only, that label's smoothed share."""
    rng = np.random.default_rng(settings.seed)
    n_in, n_out = x.shape[1], settings.hidden
    net = Network(np.zeros(n_in), np.ones(n_in), rng.normal(0, 1 / np.sqrt(n_in), (n_in, n_out)), np.zeros(n_out), np.zeros(n_out), 0.0)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        net.second_bias = float(np.log(share / (1 - share)))
        return net
    net.mean, net.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    order = rng.permutation(len(x))
    n_held = max(1, int(len(x) * settings.calibration_share))
    held, used = order[:n_held], order[n_held:] if len(x) > n_held else order
    z, t = (x[used] - net.mean) / net.scale, y[used].astype(float)
    net.second = rng.normal(0, 1 / np.sqrt(n_out), n_out)
    moving = [np.zeros_like(net.first), np.zeros(n_out), np.zeros(n_out), 0.0]
    steps, done = settings.epochs * -(-len(z) // settings.batch), 0
    for _ in range(settings.epochs):
        turn = rng.permutation(len(z))
        for lo in range(0, len(z), settings.batch):
            at = turn[lo:lo + settings.batch]
            rate = settings.rate * (1 - done / steps)
            done += 1
            hidden = np.tanh(z[at] @ net.first + net.first_bias)
            wrong = (_logistic(hidden @ net.second + net.second_bias) - t[at]) / len(at)
            back = np.outer(wrong, net.second) * (1 - hidden ** 2)
            grads = [z[at].T @ back + settings.decay * net.first, back.sum(axis=0), hidden.T @ wrong + settings.decay * net.second, wrong.sum()]
            moving = [settings.momentum * m - rate * g for m, g in zip(moving, grads)]
            net.first = net.first + moving[0]
            net.first_bias = net.first_bias + moving[1]
            net.second = net.second + moving[2]
            net.second_bias = float(net.second_bias + moving[3])
    logits, truth = net.logits(x[held]), y[held].astype(float)
    grid = np.geomspace(0.2, 20, 100)
    loss = [np.logaddexp(0, np.where(truth == 1, -logits, logits) / k).mean() for k in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


# --- Spark --------------------------------------------------------------------------------

@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def pooled(docs: DataFrame, vectors: np.ndarray, text_col: str = "text") -> Column:
    """Column of ``features`` as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.arrow_udf("array<double>")
    def pool(col: pa.Array) -> pa.Array:
        x = features(col, shared.value)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))

    return pool(F.col(f"`{text_col}`"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings(), *, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model:
    """Word vectors from all texts of ``docs``; the network from rows that
    ``usable`` (over the id) admits and whose label is 0 or 1.

    Rows with no id, text or such a label don't train.  An id with several texts
    marks all of them, an id with both labels trains both; equal rows that are
    drawn count once.  The sample is drawn by hash from each label's own count,
    so both labels are learned at every size.  Other columns don't matter.
    """
    vectors = word_vectors(context_vectors(docs, settings, text_col))
    y = F.col(f"`{label_col}`").cast("int")
    marked = labels.where(usable & y.isin(0, 1)).select(F.col(f"`{id_col}`").alias("id"), y.alias("y")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    rows = rows.withColumn("h", F.xxhash64(F.lit(settings.seed), "id", "text"))
    joined = written(rows.select("id", "h").join(marked, "id"), "labelled")  # three numbers a row
    counts = {r["y"]: r["n"] for r in joined.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total, grain = max(sum(counts.values()), 1), 1 << 30
    below = [int(grain * min(1.0, max(settings.sample_rows / total, settings.label_rows / max(counts.get(k, 0), 1)))) for k in (0, 1)]
    drawn = joined.where(F.pmod("h", F.lit(grain)) < F.when(F.col("y") == 0, below[0]).otherwise(below[1])).distinct()
    found = (rows.join(F.broadcast(drawn), ["id", "h"])  # bounded by the settings
             .select("id", "h", "y", pooled(docs, vectors, "text").alias("x"))
             .groupBy("id", "h", "y").agg(F.first("x").alias("x")).collect())
    found.sort(key=lambda r: (r["h"], r["y"], r["id"]))
    x = np.array([r["x"] for r in found]).reshape(-1, N_FEATURES)
    return Model(vectors, train(x, np.array([r["y"] for r in found]), settings))


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_quality`` (replaced if there is one): the
    calibrated probability of label 1.  Null and blank texts share the score of
    a text without words.  One pass, no shuffle; the broadcast model has a
    fixed size (2 MB of word vectors)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(col: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array(m.network.scores(features(col, m.vectors)))

    return docs.withColumn("_quality", judge(F.col(f"`{text_col}`")))
