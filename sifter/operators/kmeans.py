"""K-means distance anomaly detector.

Missing values count as 0.0; k = max(1, min(n_clusters, n)); a row's score
is its distance to its own centre (rounded to 6); the threshold is mean +
2 * population std of the distances; flag when strictly above.

The centres come from ``pyspark.ml.clustering.KMeans`` on the distinct values
weighted by their counts (same objective; a value held by a third of all rows
is one weighted point): the fit with the least cost of ``n_init`` seeds.
Scoring is a closed-form nearest-centre expression over at most ``k`` literal
centres, without vectors or a UDF.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.cols import nan_to_null
from sifter.operators.anomaly import Detector


@dataclass
class KMeansModel(Detector):
    n_clusters: int = 3
    n_init: int = 10
    patience: int = 3
    seed: int = 42
    max_iter: int = 300
    tol: float = 1e-4
    value: str = "value"
    centres: list = field(default_factory=list)
    threshold: float = 0.0
    fitted: bool = False

    def _x(self, df: DataFrame):
        return F.coalesce(nan_to_null(F.col(self.value), df.schema[self.value].dataType),
                          F.lit(0.0))

    # -------------------------------------------------------------- fit
    def fit(self, df: DataFrame) -> "KMeansModel":
        st = df.select(self._x(df).alias("x")).agg(F.count("x").alias("n"), F.avg("x").alias("m")).first()
        self.fitted, self.centres = False, []
        if not st["n"]:
            return self
        k = max(1, min(self.n_clusters, int(st["n"])))
        self.centres = [st["m"]] if k == 1 else self._centres(df, k)
        return self.calibrate(df)

    def _centres(self, df: DataFrame, k: int) -> list[float]:
        """The cheapest of up to ``n_init`` fits over the distinct values, which are
        counted once; no more seeds are tried after ``patience`` in a row that
        bring no lower cost."""
        points = df.select(self._x(df).alias("x")).groupBy("x").agg(F.count("*").cast("double").alias("w"))
        points = VectorAssembler(inputCols=["x"], outputCol="v").transform(points).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            best, cost, vain = None, math.inf, 0
            for i in range(self.n_init):
                fit = KMeans(k=k, seed=self.seed + i, maxIter=self.max_iter, tol=self.tol, featuresCol="v", weightCol="w").fit(points)
                found = fit.summary.trainingCost
                vain = 0 if found < cost * (1 - 1e-9) else vain + 1
                if found < cost:
                    best, cost = fit, found
                if vain >= self.patience:
                    break
            return sorted(float(c[0]) for c in best.clusterCenters())
        finally:
            points.unpersist()

    def calibrate(self, df: DataFrame) -> "KMeansModel":
        """The threshold of the given centres from the distances in ``df``."""
        d = self._distance(self._x(df))
        st = df.agg(F.avg(d).alias("m"), F.stddev_pop(d).alias("s")).first()
        self.fitted = st["m"] is not None
        self.threshold = (st["m"] or 0.0) + 2 * (st["s"] or 0.0)
        return self

    def state(self) -> dict:
        return {"centres": self.centres, "threshold": self.threshold}

    def restore(self, spark: SparkSession, state: dict) -> "KMeansModel":
        self.centres, self.threshold, self.fitted = state["centres"], state["threshold"], True
        return self

    # -------------------------------------------------------------- transform
    def _distance(self, x):
        gaps = [F.abs(x - F.lit(float(c))) for c in self.centres]
        return F.least(*gaps) if len(gaps) > 1 else gaps[0]

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            self.fit(df)
        if not self.fitted:
            return df.limit(0).withColumn("is_anomaly", F.lit(False)) \
                     .withColumn("anomaly_score", F.lit(None).cast("double"))
        d = self._distance(self._x(df))
        return df.withColumn("_d", d) \
                 .withColumn("is_anomaly", F.col("_d") > F.lit(self.threshold)) \
                 .withColumn("anomaly_score", F.round("_d", 6)).drop("_d")
