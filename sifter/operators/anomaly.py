"""Anomaly detectors, severity scoring and their summaries.

Detectors follow a fit / transform contract (J10): ``fit`` computes a
bounded set of statistics with one aggregation (partial aggregation on every
executor, a handful of numbers on the driver); ``transform`` applies them to
every row as literal-parameterised column expressions.  No detector joins the
statistics back or uses a window over the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.cols import is_numeric, nan_to_null
from sifter.functions.quantile import column_quantiles

# Default severity thresholds and labels.
SEVERITY_THRESHOLDS = {"low": 1.0, "medium": 2.0, "high": 3.0}


def _v(df: DataFrame, c: str):
    return nan_to_null(F.col(f"`{c}`"), df.schema[c].dataType)


class Detector:
    """J10 contract: ``fit`` on one frame, ``transform`` any frame,
    ``evaluate`` = transform + E19 summary (total and anomaly counts)."""

    def state(self) -> dict:
        """What ``fit`` found, as plain values (``detectors.save`` stores it)."""
        return {}

    def restore(self, spark: SparkSession, state: dict) -> "Detector":
        """Take over what another detector's ``fit`` found."""
        for name, found in state.items():
            setattr(self, name, found)
        return self

    def evaluate(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = self.transform(df)
        return rows, detector_summary(rows)


# ---------------------------------------------------------------- J1

@dataclass
class ThresholdModel(Detector):
    """Anomaly iff value is present and strictly above ``threshold``."""
    threshold: float
    value: str = "value"

    def fit(self, df: DataFrame) -> "ThresholdModel":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        v = _v(df, self.value)
        return df.withColumn("is_anomaly", F.coalesce(v > F.lit(self.threshold), F.lit(False))) \
                 .withColumn("anomaly_score", F.lit(None).cast("double"))


# ---------------------------------------------------------------- J2

@dataclass
class ZScoreModel(Detector):
    """|x - mean| / population std; flag when the unrounded score is
    strictly above ``threshold``; score rounded to 4.  A zero or undefined
    std, or a missing value, gives no flag and a null score."""
    threshold: float = 2.0
    value: str = "value"
    mean: float | None = None
    std: float | None = None

    def fit(self, df: DataFrame) -> "ZScoreModel":
        v = _v(df, self.value)
        row = df.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).first()
        self.mean = row["m"] if row["m"] is not None else 0.0
        self.std = row["s"] if row["s"] is not None else 0.0
        return self

    def state(self) -> dict:
        return {"mean": self.mean, "std": self.std}

    def transform(self, df: DataFrame) -> DataFrame:
        if self.mean is None:
            self.fit(df)
        v = _v(df, self.value)
        if not self.std:
            z = F.lit(None).cast("double")
        else:
            z = F.abs((v - F.lit(self.mean)) / F.lit(self.std))
        return df.withColumn("is_anomaly", F.coalesce(z > F.lit(self.threshold), F.lit(False))) \
                 .withColumn("anomaly_score", F.round(z, 4))


# ---------------------------------------------------------------- J3, J4, E30

def iqr_fences(df: DataFrame, columns: Sequence[str], accuracy: str = "exact",
               k: float = 1.5) -> dict[str, tuple[float, float]]:
    """(q1 - k*IQR, q3 + k*IQR) per column, linear interpolation.

    All columns share the scans (``column_quantiles``); the result is one
    pair per column."""
    if not columns:
        return {}
    if accuracy == "exact":
        got = {c: q for c, (_, q) in column_quantiles(df, {c: _v(df, c) for c in columns}, [0.25, 0.75]).items()}
    else:
        one = df.agg(*[F.percentile_approx(_v(df, c), [0.25, 0.75], 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        got = {c: one[f"q{i}"] for i, c in enumerate(columns) if one[f"q{i}"]}
    out = {c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1)) for c, (q1, q3) in got.items()}
    return out


@dataclass
class IQRModel(Detector):
    """Per numeric column flag values outside the IQR fences; the
    score is the number of columns out of range."""
    columns: Sequence[str] | None = None
    accuracy: str = "exact"
    fences: dict = field(default_factory=dict)

    def _cols(self, df: DataFrame) -> list[str]:
        if self.columns is not None:
            return list(self.columns)
        return [f.name for f in df.schema.fields if is_numeric(f.dataType)
                and f.name not in ("is_anomaly", "anomaly_score")]

    def fit(self, df: DataFrame) -> "IQRModel":
        self.fences = iqr_fences(df, self._cols(df), self.accuracy)
        return self

    def state(self) -> dict:
        return {"columns": list(self.fences), "fences": {c: list(f) for c, f in self.fences.items()}}

    def transform(self, df: DataFrame) -> DataFrame:
        cols = self._cols(df)
        if not cols:
            return df
        if not self.fences:
            self.fit(df)
        score = F.lit(0.0)
        for c in cols:
            if c not in self.fences:
                continue
            lo, hi = self.fences[c]
            v = _v(df, c)
            out = F.coalesce((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(False))
            score = score + F.when(out, 1.0).otherwise(0.0)
        return df.withColumn("anomaly_score", score) \
                 .withColumn("is_anomaly", F.col("anomaly_score") > 0)


def iqr_detect(flat: DataFrame, accuracy: str = "exact") -> DataFrame:
    """J3 on flat records: derived metrics first, then the IQR model over
    every numeric column (numeric entity_id and the derived columns too)."""
    from sifter.operators.reshape import derived_metrics
    feats = derived_metrics(flat)
    if not any(is_numeric(f.dataType) for f in feats.schema.fields):
        return feats
    return IQRModel(accuracy=accuracy).fit(feats).transform(feats)


def column_fence_flags(df: DataFrame, column: str, accuracy: str = "exact") -> tuple[DataFrame, dict]:
    """Fences, flag and count for one chosen column."""
    model = IQRModel(columns=[column], accuracy=accuracy).fit(df)
    flagged = model.transform(df)
    return flagged, model.fences.get(column)


# ---------------------------------------------------------------- J5

def severity(scored: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Score >= high -> critical, >= medium -> high, >= low -> medium,
    else low; alert ALERT / OK.  Missing columns take defaults."""
    t = thresholds or SEVERITY_THRESHOLDS
    df = scored
    if "anomaly_score" not in df.columns:
        df = df.withColumn("anomaly_score", F.lit(0.0))
    if "is_anomaly" not in df.columns:
        df = df.withColumn("is_anomaly", F.lit(False))
    s = F.col("anomaly_score")
    sev = (F.when(s >= F.lit(t["high"]), "critical")
           .when(s >= F.lit(t["medium"]), "high")
           .when(s >= F.lit(t["low"]), "medium")
           .otherwise("low"))
    return df.withColumn("severity", sev) \
             .withColumn("alert", F.when(F.col("is_anomaly"), "ALERT").otherwise("OK"))


# ---------------------------------------------------------------- E16-E19

def _defaults(scored: DataFrame) -> DataFrame:
    df = scored
    if "is_anomaly" not in df.columns:
        df = df.withColumn("is_anomaly", F.lit(False))
    if "anomaly_score" not in df.columns:
        df = df.withColumn("anomaly_score", F.lit(0.0))
    if "severity" not in df.columns:
        df = df.withColumn("severity", F.lit("low"))
    return df


def evaluation(scored: DataFrame) -> DataFrame:
    """Total, anomaly count and rate (zeros for an empty input)."""
    df = _defaults(scored)
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_if(F.col("is_anomaly")).alias("anomaly_count")) \
             .withColumn("anomaly_rate", F.when(F.col("total_records") > 0,
                                                F.col("anomaly_count") / F.col("total_records"))
                         .otherwise(F.lit(0.0)))


def severity_breakdown(scored: DataFrame) -> DataFrame:
    """Count per severity."""
    return _defaults(scored).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def score_distribution(scored: DataFrame) -> DataFrame:
    """Count per score ascending; the key rendered as text (``3.0``)."""
    df = _defaults(scored)
    return (df.groupBy("anomaly_score").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("anomaly_score")
            .select(F.col("anomaly_score").cast("string").alias("score"), "count"))


def detector_summary(pred: DataFrame) -> DataFrame:
    """total_records and anomaly_count of a detector's output."""
    return pred.agg(F.count(F.lit(1)).alias("total_records"),
                    F.count_if(F.coalesce(F.col("is_anomaly"), F.lit(False))).alias("anomaly_count"))


def ml_context(records: DataFrame) -> dict:
    """Field-role context; value null when there are no records."""
    has_rows = records.limit(1).count() > 0
    return {"identifier": "entity_id", "time": "timestamp",
            "value": "value" if has_rows else None}
