"""A key or value holding a third of all rows must give exact results and
must not be gathered into one window partition."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sifter.functions.order import with_ordinal
from sifter.functions.quantile import quantiles
from sifter.operators import metrics, validate
from sifter.operators.kmeans import KMeansModel

N = 3000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicates_hot_key(spark):
    ids = np.where(np.arange(N) % 3 == 0, "hot", np.char.add("k", (np.arange(N) // 2).astype(str)))
    pdf = pd.DataFrame({"entity_id": ids, "timestamp": "2026-01-01", "o": np.arange(N)})
    df = with_ordinal(spark.createDataFrame(pdf), ["o"])
    dups = validate.duplicates(df)
    hot = pdf[pdf.entity_id == "hot"]
    cold = pdf[pdf.entity_id != "hot"]
    expected = (len(hot) - 1) + (len(cold) - cold.entity_id.nunique())
    assert dups.count() == expected
    assert dups.where("entity_id = 'hot'").agg(F.min("record_index")).first()[0] == 3
    # the only windows are over the per-partition offsets table, none over the key
    plan = _plan(dups.where("entity_id = 'hot'"))
    assert "windowspecdefinition(entity_id" not in plan
    assert all("_sifter_pid" in line for line in plan.split("\n") if "Window [" in line)


def test_quantile_hot_value(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.full(N // 3, 7.0), rng.normal(size=2 * N // 3)])
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    r = quantiles(df, "v", [0.1, 0.5, 0.9]).first()
    assert abs(r["q_0_5"] - np.quantile(vals, 0.5)) < 1e-12
    assert abs(r["q_0_9"] - np.quantile(vals, 0.9)) < 1e-12


def test_roc_auc_hot_score(spark):
    rng = np.random.default_rng(2)
    score = np.where(np.arange(N) % 3 == 0, 0.5, rng.uniform(size=N))
    label = (rng.uniform(size=N) < score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"label": label, "anomaly_score": score}))
    got = metrics.roc_auc(df).first()["roc_auc"]
    # brute force: pairs, ties count half
    pos, neg = score[label == 1], score[label == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
        / (len(pos) * len(neg))
    assert got == round(auc, 4)


def test_kmeans_hot_value(spark):
    vals = np.concatenate([np.full(N // 3, 5.0), np.linspace(100, 110, N // 3),
                           np.linspace(500, 520, N // 3)])
    df = spark.createDataFrame(pd.DataFrame({"value": vals}))
    m = KMeansModel(n_clusters=3).fit(df)
    assert abs(m.centres[0] - 5.0) < 1e-9
    assert abs(m.centres[1] - 105.0) < 1e-6 and abs(m.centres[2] - 510.0) < 1e-6
