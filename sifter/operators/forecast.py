"""Forecasts over an ordered series.

The series order is an explicit key.  Positions come from the distributed
ordinal (``with_ordinal``), the trend from ``regr_slope``/``regr_intercept``
(a one-row aggregate), and the moving-average recursion from the last
``window`` values (a distributed top-k) folded with ``aggregate`` over
``sequence(1, steps)`` -- all JVM-side.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.cols import nan_to_null
from sifter.functions.order import with_ordinal

PRED_COLS = ["entity_id", "timestamp", "value", "is_anomaly", "anomaly_score"]


def _future(spark, steps: int, values_expr) -> DataFrame:
    return spark.range(1, steps + 1).select(
        F.lit("future").alias("entity_id"),
        F.concat(F.lit("t+"), F.col("id").cast("string")).alias("timestamp"),
        values_expr.alias("value"),
        F.lit(False).alias("is_anomaly"),
        F.lit(None).cast("double").alias("anomaly_score"))


def linear_trend(records: DataFrame, order_by: Sequence[str], steps: int = 5,
                 value: str = "value", actual: str | None = None) -> DataFrame:
    """OLS of value on position 0..n-1 over the present values (in
    order); fitted rows for those values and ``steps`` future rows, all
    rounded to 4.  No values -> no rows; one value -> error.  ``actual`` names
    an extra column with the observed value (null on future rows)."""
    seen = f", {actual} double" if actual else ""
    v = nan_to_null(F.col(value), records.schema[value].dataType)
    present = records.where(v.isNotNull()).withColumn(value, v)
    indexed = with_ordinal(present, order_by, name="_x")
    fit = indexed.agg(F.count(F.lit(1)).alias("n"),
                      F.regr_slope(F.col(value), F.col("_x").cast("double")).alias("slope"),
                      F.regr_intercept(F.col(value), F.col("_x").cast("double")).alias("icpt")).first()
    n = fit["n"]
    spark = records.sparkSession
    if n == 0:
        return spark.createDataFrame([], "entity_id string, timestamp string, value double, "
                                         "is_anomaly boolean, anomaly_score double" + seen)
    if n < 2 or fit["slope"] is None:
        raise ValueError("Linear trend needs at least two values")
    slope, icpt = float(fit["slope"]), float(fit["icpt"])

    def pred(x):
        p = F.lit(icpt) + F.lit(slope) * x
        return F.when(F.isnan(p), F.lit(0.0)).otherwise(F.round(p, 4))

    fitted = indexed.select(
        F.col("entity_id").cast("string").alias("entity_id"),
        F.col("timestamp").cast("string").alias("timestamp"),
        pred(F.col("_x").cast("double")).alias("value"),
        F.lit(False).alias("is_anomaly"), F.lit(None).cast("double").alias("anomaly_score"),
        *([F.col(value).cast("double").alias(actual)] if actual else []))
    future = _future(spark, steps, pred((F.col("id") + F.lit(n - 1)).cast("double")))
    return fitted.unionByName(future, allowMissingColumns=True)


def moving_average(records: DataFrame, order_by: Sequence[str], steps: int = 5,
                   window: int = 2, value: str = "value") -> DataFrame:
    """existing rows unchanged, then ``steps`` rows each the mean of the
    last ``window`` values of the history *including earlier forecasts*,
    rounded to 4 at every step.  No present value -> no rows."""
    v = nan_to_null(F.col(value), records.schema[value].dataType)
    spark = records.sparkSession
    # last ``window`` present values: a distributed top-k (TakeOrderedAndProject)
    order_desc = [F.col(c).desc() for c in order_by]
    tail = (records.where(v.isNotNull()).select(*order_by, v.alias("_v"))
            .orderBy(*order_desc).limit(window))
    seed = tail.agg(F.reverse(F.collect_list(F.struct(*[F.col(c) for c in order_by], "_v"))
                              ).alias("_s"))
    if seed.first()["_s"] in (None, []):
        return spark.createDataFrame([], "entity_id string, timestamp string, value double, "
                                         "is_anomaly boolean, anomaly_score double")
    existing = records.select(
        F.col("entity_id").cast("string").alias("entity_id"),
        F.col("timestamp").cast("string").alias("timestamp"),
        v.alias("value"), F.lit(False).alias("is_anomaly"),
        F.lit(None).cast("double").alias("anomaly_score"))
    # history array in ascending order, then the recursion on it
    hist = F.transform(F.array_sort(F.col("_s"), _cmp_fields(order_by)), lambda s: s["_v"])

    def step(acc, _):
        # the last ``window`` entries, or all of them when the history is shorter
        last = F.slice(acc, F.greatest(F.size(acc) - window + 1, F.lit(1)), window)
        avg = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)
        nxt = F.when(F.isnan(avg), F.lit(0.0)).otherwise(F.round(avg, 4))
        return F.concat(acc, F.array(nxt))

    grown = seed.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), hist, step).alias("_h"),
                        F.size(hist).alias("_k"))
    future = grown.select(F.posexplode(F.slice("_h", F.col("_k") + 1, steps)).alias("_i", "value")) \
        .select(F.lit("future").alias("entity_id"),
                F.concat(F.lit("t+"), (F.col("_i") + 1).cast("string")).alias("timestamp"),
                "value", F.lit(False).alias("is_anomaly"),
                F.lit(None).cast("double").alias("anomaly_score")) if steps > 0 else None
    return existing if future is None else existing.unionByName(future)


def _cmp_fields(order_by: Sequence[str]):
    def cmp(a, b):
        res = F.lit(0)
        for c in reversed(list(order_by)):
            res = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(res)
        return res
    return cmp


def forecast_summary(pred: DataFrame) -> DataFrame:
    """E19 for forecasters: all rows, zero anomalies."""
    return pred.agg(F.count(F.lit(1)).alias("total_records"),
                    F.lit(0).cast("long").alias("anomaly_count"))
