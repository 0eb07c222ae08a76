"""Model-quality metrics.

Predictions and truth sit on the same row (our detectors keep the label next
to the score), so the reference's positional ``zip`` becomes nothing, or an
equi-join on ``record_index`` when they come from different frames (D1).
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.cols import nan_to_null
from sifter.functions.order import running_total

DIGITS = 4


def align(records: DataFrame, predictions: DataFrame, index: str = "record_index") -> DataFrame:
    """Pair the i-th record with the i-th prediction (inner equi-join)."""
    p = predictions.select(index, *[F.col(c).alias(f"pred_{c}") for c in predictions.columns
                                    if c != index])
    return records.join(p, index)


def regression_metrics(df: DataFrame, y: str = "value", yhat: str = "prediction") -> DataFrame:
    """MAE, MSE, RMSE, R^2 (0 when the total sum of squares is 0) and
    support over rows where both sides are present; rounded to 4."""
    t = nan_to_null(F.col(y), df.schema[y].dataType)
    p = nan_to_null(F.col(yhat), df.schema[yhat].dataType)
    both = df.select(t.alias("y"), p.alias("p")).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    d = F.col("y") - F.col("p")
    agg = both.agg(F.count(F.lit(1)).alias("support"), F.avg(F.abs(d)).alias("mae"),
                   F.avg(d * d).alias("mse"), F.var_pop("y").alias("vy"))
    r2 = F.when(F.col("support") == 0, None) \
          .when(F.col("vy") > 0, F.lit(1.0) - F.col("mse") / F.col("vy")).otherwise(F.lit(0.0))
    return agg.select(F.round("mae", DIGITS).alias("mae"), F.round("mse", DIGITS).alias("mse"),
                      F.round(F.sqrt("mse"), DIGITS).alias("rmse"), F.round(r2, DIGITS).alias("r2"),
                      "support")


def classification_metrics(df: DataFrame, label: str = "label",
                           flag: str = "is_anomaly") -> DataFrame:
    """Confusion counts, precision, recall and F1 over labelled rows
    (0 when undefined; nulls when no row is labelled)."""
    y = F.col(label).cast("long")
    f = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    lab = df.where(F.col(label).isNotNull())
    c = lab.agg(F.count(F.lit(1)).alias("support"),
                F.count_if((y == 1) & f).alias("true_positives"),
                F.count_if((y == 0) & f).alias("false_positives"),
                F.count_if((y == 0) & ~f).alias("true_negatives"),
                F.count_if((y == 1) & ~f).alias("false_negatives"))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    c = c.withColumn("_p", prec).withColumn("_r", rec)
    f1 = F.when(F.col("_p") + F.col("_r") > 0,
                2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    none = F.col("support") == 0
    return c.select(
        F.when(none, None).otherwise(F.round("_p", DIGITS)).alias("precision"),
        F.when(none, None).otherwise(F.round("_r", DIGITS)).alias("recall"),
        F.when(none, None).otherwise(F.round(f1, DIGITS)).alias("f1_score"),
        "support", "true_positives", "false_positives", "true_negatives", "false_negatives")


def roc_auc(df: DataFrame, label: str = "label", score: str = "anomaly_score",
            higher_is_anomalous: bool = True) -> DataFrame:
    """Exact area under the ROC curve with ties counted half.

    AUC = sum over distinct scores s of pos(s) * (neg(<s) + neg(s)/2) / (P*N).
    Rows are first reduced to one row per distinct score (partial
    aggregation absorbs hot scores); the running count of negatives below
    each score is a distributed prefix sum.  A single class gives null."""
    s = nan_to_null(F.col(score), df.schema[score].dataType)
    if not higher_is_anomalous:
        s = -s
    rows = df.select(F.col(label).cast("long").alias("y"), s.alias("s")) \
             .where(F.col("y").isNotNull() & F.col("s").isNotNull())
    per_score = rows.groupBy("s").agg(F.count_if(F.col("y") == 1).alias("pos"),
                                      F.count_if(F.col("y") != 1).alias("neg"))
    ranked = running_total(per_score, ["s"], ["neg"], prefix="below_")
    area = ranked.agg(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0)).alias("a"),
                      F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return area.select(
        F.when((F.col("P") > 0) & (F.col("N") > 0),
               F.round(F.col("a") / (F.col("P") * F.col("N")), DIGITS)).alias("roc_auc"),
        (F.coalesce(F.col("P"), F.lit(0)) + F.coalesce(F.col("N"), F.lit(0))).cast("long")
        .alias("support"))


def model_comparison(model_type: str, results: Mapping[str, DataFrame]) -> DataFrame:
    """Metric rows of several models under one model type."""
    out = None
    for name, frame in results.items():
        tagged = frame.select(F.lit(model_type).alias("model_type"), F.lit(name).alias("model"),
                              *frame.columns)
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
