"""Plan-shape guarantees of the registered queries (see README, Plan audit)."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["adapt_canonical", "validate_records", "duplicates", "cleaning_audit", "numeric_summary",
         "grouped_box_stats", "scatter_encoded", "iqr_anomaly", "zscore_anomaly", "linear_trend",
         "moving_average", "roc_auc", "thinned_labels", "histogram"]


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan, f"{name}: {bad}"
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            feeder = lines[i + 1]
            # only bounded inputs: a partial aggregate, or a table of per-range counts
            assert "HashAggregate" in feeder or "_sifter_pid" in feeder, f"{name}: {feeder}"
