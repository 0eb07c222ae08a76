"""Stored detectors (J10): fit on one table, keep the state, apply it elsewhere.

A fitted detector is a bounded set of numbers.  It is stored as a table of one
row (kind, settings, state), so it can lie beside the data it belongs to, and a
loaded one scores another table or a stream without seeing the training data.
"""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from sifter.operators.anomaly import Detector, IQRModel, ThresholdModel, ZScoreModel
from sifter.operators.forest import IsolationForestModel
from sifter.operators.kmeans import KMeansModel

KINDS = {"threshold": ThresholdModel, "zscore": ZScoreModel, "iqr": IQRModel, "kmeans": KMeansModel, "isolation_forest": IsolationForestModel}
_FITTED = {"mean", "std", "fences", "centres", "fitted"}  # dataclass fields that a fit sets; KMeans' threshold too


def to_frame(spark: SparkSession, detector: Detector) -> DataFrame:
    """One row: kind, settings and state (both JSON)."""
    kind = next(k for k, cls in KINDS.items() if type(detector) is cls)
    fitted = _FITTED | ({"threshold"} if kind == "kmeans" else set())
    settings = {f.name: getattr(detector, f.name) for f in fields(detector) if f.name not in fitted}
    if getattr(detector, "fitted", True) is False:
        raise ValueError("the detector is not fitted")
    return spark.createDataFrame([(kind, json.dumps(settings), json.dumps(detector.state()))], "kind string, settings string, state string")


def from_frame(frame: DataFrame) -> Detector:
    row = frame.first()
    detector = KINDS[row["kind"]](**json.loads(row["settings"]))
    return detector.restore(frame.sparkSession, json.loads(row["state"]))


def save(spark: SparkSession, detector: Detector, path: str) -> None:
    to_frame(spark, detector).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Detector:
    return from_frame(spark.read.parquet(path))
