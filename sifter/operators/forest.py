"""Isolation-forest anomaly detector on one value column.

Semantics (Liu, Ting and Zhou, 2008): ``n_trees`` trees, each grown on
psi = min(max_samples, n) values drawn without replacement, to depth
ceil(log2 psi); a value's path length is the leaf depth plus c(leaf size);
score = -2^(-E[h]/c(psi)) (lower = more anomalous); the offset is the
``contamination`` quantile of the training scores; decision = score -
offset; flagged when negative.  Missing values are scored as 0.0.

Spark plan:
1. every tree draws psi different positions out of 0 .. n - 1; a tree's sample
   are the values at these positions of the sorted column.  Values are counted
   first, so a value that a third of the rows hold is one row, and each of its
   copies is as likely drawn as any other row; running totals of the counts
   (no global window) tell which value lies at a position.  The sample is
   exactly psi values and depends on the values alone, not on partitions;
2. ``groupBy(tree).applyInPandas`` grows one tree per group (psi values);
   in one dimension a tree is a step function of the value, emitted as
   (interval start, path length);
3. the trees (at most n_trees * psi leaves in all, a bounded model) are
   merged into one step function of the value;
4. every row is scored JVM-side: ``Bucketizer`` (binary search over the
   breakpoints) + a broadcast lookup of the bucket's score;
5. the offset is the exact quantile of the training scores, computed from
   the number of training values per bucket (one map-side-combined pass).
The random stream differs from other implementations; the tests check the
invariants (flag rate, the extreme value flagged, determinism per seed) and a
brute-force score of a grown forest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.cols import nan_to_null
from sifter.functions.order import running_total
from sifter.operators.anomaly import Detector
from sifter.session import ship_package

EULER_GAMMA = 0.5772156649015329


def c_factor(n: int) -> float:
    """Average path length of an unsuccessful search in a BST of n nodes."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def _grow(seed: int, max_depth: int):
    """applyInPandas body: one tree per group -> (tree, start, h) rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        out_start, out_h = [], []
        stack = [(np.sort(pdf["x"].to_numpy(dtype=float)), 0, -np.inf)]
        # depth-first, left before right, so intervals come out in order
        while stack:
            vals, depth, lo = stack.pop()
            n = len(vals)
            if depth >= max_depth or n <= 1 or vals[0] == vals[-1]:
                out_start.append(lo)
                out_h.append(depth + c_factor(n))
                continue
            u = rng.uniform()
            split = vals[0] * (1 - u) + vals[-1] * u  # no overflow, whatever the range
            if not vals[0] < split <= vals[-1]:  # rounded to the end
                split = vals[-1]
            cut = np.searchsorted(vals, split, side="left")
            stack.append((vals[cut:], depth + 1, split))   # right, popped second
            stack.append((vals[:cut], depth + 1, lo))      # left, popped first
        return pd.DataFrame({"tree": tree, "start": out_start, "h": out_h})

    return run


def _weighted_quantile(values: np.ndarray, counts: np.ndarray, p: float) -> float:
    """Linear-interpolated quantile of ``values`` repeated ``counts`` times
    (the same definition as ``exact_quantiles``)."""
    order = np.argsort(values, kind="stable")
    v, c = values[order], counts[order].astype(np.int64)
    cum = np.cumsum(c)
    n = int(cum[-1])
    pos = p * (n - 1)
    lo = int(math.floor(pos))
    hi = min(lo + 1, n - 1)
    v_lo = v[np.searchsorted(cum, lo, side="right")]
    v_hi = v[np.searchsorted(cum, hi, side="right")]
    return float(v_lo + (v_hi - v_lo) * (pos - lo))


@dataclass
class IsolationForestModel(Detector):
    contamination: float = 0.1
    n_trees: int = 100
    max_samples: int = 256
    seed: int = 42
    value: str = "value"
    fitted: bool = False

    def _present(self, df: DataFrame):
        return nan_to_null(F.col(self.value), df.schema[self.value].dataType)

    # -------------------------------------------------------------- fit
    def sample(self, values: DataFrame, n: int, psi: int) -> DataFrame:
        """(tree, x): psi of the n values of column x per tree, without replacement."""
        draws = [np.random.default_rng([self.seed, t, 1]).choice(n, psi, replace=False, shuffle=False) for t in range(self.n_trees)]
        position, tree = np.concatenate(draws).astype(np.int64), np.repeat(np.arange(self.n_trees, dtype=np.int32), psi)
        order = np.argsort(position, kind="stable")
        drawn = values.sparkSession.sparkContext.broadcast((position[order], tree[order]))  # n_trees * psi numbers

        def pick(batches):
            position, tree = drawn.value
            for batch in batches:
                x, c, before = (batch.column(k).to_numpy() for k in ("x", "c", "before_c"))
                lo, hi = np.searchsorted(position, before), np.searchsorted(position, before + c)
                at = np.repeat(np.arange(len(x)), hi - lo)
                nth = np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + lo[at]
                yield pa.RecordBatch.from_arrays([pa.array(tree[nth]), pa.array(x[at])], names=["tree", "x"])

        counts = values.groupBy("x").agg(F.count("*").alias("c"))
        return running_total(counts, ["x"], ["c"]).select("x", "c", "before_c").mapInArrow(pick, "tree int, x double")

    def fit(self, df: DataFrame) -> "IsolationForestModel":
        spark = df.sparkSession
        ship_package(spark)  # trees are grown in Python workers
        most = float(np.finfo(float).max)
        train = df.select(self._present(df).cast("double").alias("x")).where("x is not null")
        train = train.select(F.greatest(F.lit(-most), F.least(F.lit(most), F.col("x"))).alias("x"))  # infinities are the ends
        n = train.count()
        if n == 0:
            self.fitted = False
            return self
        psi = min(self.max_samples, n)
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        sample = self.sample(train, n, psi)
        # 2. grow one tree per group (psi values each); a tree has at most
        #    2^max_depth leaves, so the forest is at most n_trees * psi rows
        steps = sample.groupBy("tree").applyInPandas(
            _grow(self.seed, max_depth), "tree int, start double, h double").toPandas()
        # 3. merge the trees' step functions into one (bounded model, like any
        #    fitted MLlib tree ensemble it lives on the driver)
        steps = steps.sort_values(["tree", "start"])
        steps["jump"] = steps.groupby("tree")["h"].diff().fillna(steps["h"])
        merged = steps.groupby("start", sort=True)["jump"].sum()
        eh = merged.cumsum().to_numpy() / float(self.n_trees)
        cpsi = c_factor(psi)
        scores = -np.power(2.0, -eh / (cpsi if cpsi > 0 else 1.0))
        starts = merged.index.to_numpy()
        inner = [float(x) for x in starts if x != -math.inf]
        if not inner:  # one value only: a single leaf, on both sides of any point
            inner, scores = [0.0], np.repeat(scores, 2)
        self.restore(spark, {"psi": psi, "splits": inner, "scores": scores.tolist(), "offset": 0.0})
        # 4. offset: the contamination quantile of the training scores, from
        #    the count of training values per bucket (one combined pass)
        b = Bucketizer(splits=self.splits, inputCol="x", outputCol="bucket", handleInvalid="keep")
        per = b.transform(train).groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).toPandas()
        per["score"] = scores[per["bucket"].astype(int).to_numpy()]
        self.offset = _weighted_quantile(per["score"].to_numpy(), per["c"].to_numpy(),
                                         self.contamination)
        return self

    # -------------------------------------------------------------- stored form
    def state(self) -> dict:
        return {"psi": self.psi, "splits": self.splits[1:-1], "scores": [float(x) for x in self.scores], "offset": self.offset}

    def restore(self, spark: SparkSession, state: dict) -> "IsolationForestModel":
        """Take over a fitted forest: breakpoints, a score per interval, offset."""
        self.psi, self.offset = state["psi"], state["offset"]
        self.splits = [-math.inf, *state["splits"], math.inf]
        self.scores = np.array(state["scores"])
        self.lookup = spark.createDataFrame([(float(i), float(x)) for i, x in enumerate(state["scores"])], "bucket double, score double")
        self.fitted = True
        return self

    def _score(self, df: DataFrame, col: str) -> DataFrame:
        b = Bucketizer(splits=self.splits, inputCol=col, outputCol="bucket", handleInvalid="keep")
        # lookup has at most n_trees * psi rows: a proven bound for broadcast
        return b.transform(df).join(F.broadcast(self.lookup), "bucket") \
                .withColumnRenamed("score", "_score").drop("bucket")

    # -------------------------------------------------------------- transform
    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            self.fit(df)
        if not self.fitted:
            return df.limit(0).withColumn("is_anomaly", F.lit(False)) \
                     .withColumn("anomaly_score", F.lit(None).cast("double"))
        x = F.coalesce(self._present(df), F.lit(0.0))
        scored = self._score(df.withColumn("_x", x), "_x")
        dec = F.col("_score") - F.lit(self.offset)
        return scored.withColumn("anomaly_score", dec) \
                     .withColumn("is_anomaly", dec < 0) \
                     .drop("_x", "_score")
