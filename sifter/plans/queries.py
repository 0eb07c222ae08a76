"""Named queries over the driver's tables, one per operator family.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame of plain scalar
columns.  Inputs are the given tables, whole; where an operator needs dirty
data (missing keys, junk timestamps, null features) the defect is injected
into every row that a fixed rule selects, and every row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.order import with_ordinal
from sifter.operators import anomaly, charts, forecast, metrics, profile, reshape, validate


# ---------------------------------------------------------------- inputs

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_raw(spark, d) -> DataFrame:
    """Line items under the analysis field names."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("order_date"),
        F.col("l_extendedprice").alias("sales"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("category"),
        (F.col("l_extendedprice") * (F.lit(0.1) - F.col("l_discount"))).alias("profit"))


def sales_flat(spark, d) -> DataFrame:
    return reshape.flatten(reshape.adapt(sales_raw(spark, d)))


def sales_af(spark, d) -> DataFrame:
    return reshape.analysis_frame(sales_flat(spark, d))


def indexed_events(spark, d, columns=None) -> DataFrame:
    """Events with their 0-based position by event_id.  The ordinal persists
    its input, so only the needed columns go in (a persisted frame blocks
    column pruning below it)."""
    ev = table(spark, d, "events")
    return with_ordinal(ev.select(*columns) if columns else ev, ["event_id"])


def dirty_events(spark, d, index: bool = True) -> DataFrame:
    """Events with defects injected: missing id (id % 7 = 0), missing time
    (id % 7 = 3), NaN value (id % 11 = 4), null event_type (id % 5 = 1),
    null props (id % 9 = 2).  ``record_index`` is kept alongside unless
    ``index`` is false."""
    ev = indexed_events(spark, d) if index else table(spark, d, "events")
    i = F.col("event_id")
    return ev.select(
        *(["record_index"] if index else []),
        F.when(i % 7 == 0, None).otherwise(i).alias("event_id"),
        F.when(i % 7 == 3, None).otherwise(F.col("ts")).alias("event_time"),
        "user_id",
        F.when(i % 5 == 1, None).otherwise(F.col("event_type")).alias("event_type"),
        F.when(i % 11 == 4, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.when(i % 9 == 2, None).otherwise(F.col("props")).alias("props"))


def dirty_canonical(spark, d, index: bool = True) -> DataFrame:
    return reshape.adapt(dirty_events(spark, d, index), keep=["record_index"] if index else [])


def hourly_events(spark, d, index: bool = True) -> DataFrame:
    """Events keyed by (user, hour): natural repeated keys for F2, with the
    same missing-key rule as ``dirty_events``."""
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    ev = indexed_events(spark, d, columns) if index else table(spark, d, "events").select(*columns)
    i = F.col("event_id")
    kept = ["record_index"] if index else []
    raw = ev.select(
        *kept,
        F.when(i % 7 == 0, None).otherwise(F.col("user_id")).alias("user_id"),
        F.when(i % 7 == 3, None).otherwise(F.date_trunc("hour", "ts")).alias("event_hour"),
        "event_type", "value")
    roles = reshape.Roles(["user_id"], ["event_hour"], ["event_type", "value"])
    return reshape.to_canonical(raw, roles, keep=kept)


def order_series(spark, d) -> DataFrame:
    """Orders as model records: value = first numeric feature (total price)."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), "o_orderdate", "o_totalprice",
        "o_orderstatus", "o_orderpriority")
    canon = reshape.adapt(o)
    return reshape.first_numeric_value(canon).select(
        "entity_id", "timestamp", "value")


def event_series(spark, d) -> DataFrame:
    ev = table(spark, d, "events").withColumnRenamed("ts", "event_time")
    canon = reshape.adapt(ev)
    return reshape.first_numeric_value(canon).select("entity_id", "timestamp", "value")


def document_scores(spark, d, threshold: float = 2.0) -> DataFrame:
    """Documents scored by z-score of their length, with the toxic label."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id"), F.col("n_chars").cast("double").alias("value"))
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    scored = anomaly.ZScoreModel(threshold=threshold).fit(docs).transform(docs)
    return scored.join(labels, "doc_id", "left")


# ---------------------------------------------------------------- B

def q_adapt_canonical(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "order_id")
    canon = reshape.adapt(o)
    return canon.select("entity_id", "timestamp", "features.*",
                        F.size("metadata").alias("metadata_size"))


def q_flatten_canonical(spark, d):
    ev = table(spark, d, "events").withColumnRenamed("ts", "event_time")
    return reshape.flatten_with_metadata(reshape.adapt(ev))


def q_derived_metrics(spark, d):
    out = reshape.derived_metrics(sales_flat(spark, d))
    return out.select("entity_id", "timestamp", "feature_count",
                      F.round("feature_sum", 4).alias("feature_sum"))


def q_minmax_normalise(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = reshape.minmax_normalise(part, ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"),
                      F.round("p_retailprice", 6).alias("p_retailprice"))


def _value_text_events(spark, d):
    ev = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    txt = (F.when(i % 4 == 0, F.lit("n/a"))
           .when(i % 4 == 1, F.concat(F.lit(" "), u, F.lit(" ")))
           .when(i % 4 == 2, F.concat(u, F.lit("e1"))))
    return ev.select("event_id", F.col("ts").alias("event_time"), "event_type",
                     txt.alias("amount_text"), "value")


def q_first_numeric_value(spark, d):
    canon = reshape.adapt(_value_text_events(spark, d))
    return reshape.first_numeric_value(canon).select("entity_id", "timestamp", "value")


def q_feature_dataset(spark, d):
    canon = dirty_canonical(spark, d, index=False)
    recs = reshape.model_records(canon)
    _, counts = reshape.feature_dataset(recs)
    return counts


def q_scatter_encoded(spark, d):
    ev = indexed_events(spark, d, ["event_id", "value", "event_type"])
    pairs = charts.scatter_pairs(ev, "value", "event_type", order="record_index")
    return pairs.select("record_index", "x", F.col("y").cast("long").alias("y"))


# ---------------------------------------------------------------- C, F2, E20-E24

def q_validate_records(spark, d):
    checked = validate.validate(dirty_canonical(spark, d))
    return checked.select("record_index", F.col("entity_id").cast("string").alias("entity_id"),
                          "timestamp", "status",
                          F.size("errors").alias("n_errors"),
                          F.array_join("errors", "|").alias("errors"))


def q_invalid_reasons(spark, d):
    return validate.invalid_reason_counts(validate.validate(dirty_canonical(spark, d, index=False)))


def q_batch_validation(spark, d):
    totals, _ = validate.batch_validation(dirty_canonical(spark, d, index=False))
    return totals


def q_batch_invalid_rows(spark, d):
    _, rows = validate.batch_validation(dirty_canonical(spark, d))
    return rows.select("record_index", F.array_join("errors", "|").alias("errors"))


def _junk_time_events(spark, d):
    ev = table(spark, d, "events")
    i = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(i % 13 == 1, F.date_format("ts", "yyyyMMdd"))
            .when(i % 13 == 2, F.lit(None).cast("string"))
            .when(i % 13 == 3, F.lit("not a date"))
            .when(i % 13 == 4, F.date_format("ts", "yyyy-MM-dd HH:mm"))
            .when(i % 13 == 5, F.date_format("ts", "yyyy-MM-dd"))
            .otherwise(iso))
    return ev.select("event_id", text.alias("ts_text"))


def q_timestamp_check(spark, d):
    df = _junk_time_events(spark, d)
    errs = validate.timestamp_errors("ts_text", df.schema["ts_text"].dataType)
    out = df.withColumn("errors", errs)
    return out.select("event_id", "ts_text",
                      F.when(F.size("errors") == 0, "valid").otherwise("invalid").alias("status"),
                      F.array_join("errors", "|").alias("errors"))


def q_feature_check(spark, d):
    canon = dirty_canonical(spark, d)
    errs = validate.feature_errors(canon)
    out = canon.withColumn("errors", errs)
    return out.select("record_index",
                      F.when(F.size("errors") == 0, "valid").otherwise("invalid").alias("status"),
                      F.array_join("errors", "|").alias("errors"))


def q_duplicates(spark, d):
    canon = hourly_events(spark, d)
    return validate.duplicates(canon)


def q_quality_report(spark, d):
    canon = hourly_events(spark, d)
    totals, _ = validate.batch_validation(canon)
    rep = validate.quality_report(totals, validate.duplicates(canon))
    return rep.select("pipeline_stage", "dataset_status", "records_processed", "valid_records",
                      "invalid_records", "duplicate_records",
                      F.array_join("warnings", "|").alias("warnings"))


def q_entity_lookup(spark, d):
    canon = hourly_events(spark, d, index=False)
    return validate.entity_lookup(canon, 42).select(
        "entity_id", "timestamp", F.col("features.value").alias("value"))


def q_cleaning_audit(spark, d):
    from sifter.plans.pipeline import cleaning_audit
    before = hourly_events(spark, d)
    valid, _ = validate.split_valid(before)
    dup = validate.duplicates(valid)
    after = valid.join(dup.select("record_index"), "record_index", "left_anti")
    return cleaning_audit(before.drop("record_index"), after.drop("record_index"))


def q_standard_cleaning_audit(spark, d):
    from sifter.plans.pipeline import standard_cleaning_audit
    return standard_cleaning_audit(hourly_events(spark, d), "record_index")


def q_heavy_values(spark, d):
    """One column with a hot value, one with very many values of like counts."""
    docs, items = table(spark, d, "documents"), table(spark, d, "lineitem")
    return profile.heavy_values(docs, "source").select(F.lit("source").alias("field"), "value", "count").unionByName(
        profile.heavy_values(items, "l_orderkey").select(F.lit("l_orderkey").alias("field"), F.col("value").cast("string").alias("value"), "count"))


# ---------------------------------------------------------------- E1-E14

def q_numeric_summary(spark, d):
    return profile.numeric_summary(sales_af(spark, d))


def q_date_summary(spark, d):
    return profile.date_summary(sales_af(spark, d))


def q_categorical_summary(spark, d):
    return profile.categorical_summary(sales_af(spark, d))


def q_top_values(spark, d):
    return profile.top_values(sales_af(spark, d))


def q_missing_by_column(spark, d):
    return profile.missing_by_column(reshape.flatten(dirty_canonical(spark, d, index=False)))


def q_shape(spark, d):
    return profile.shape(sales_flat(spark, d))


def q_target_stats(spark, d):
    return profile.target_stats(sales_af(spark, d))


def q_category_counts(spark, d):
    return charts.category_counts(sales_af(spark, d), "Category")


def q_grouped_mean(spark, d):
    out = charts.grouped_mean(sales_af(spark, d), "Sales", "Category")
    return out.select(F.col("key").alias("category"), F.round("mean", 4).alias("mean"))


def q_daily_mean(spark, d):
    # money as a two-place decimal: the daily mean is then exact
    af = sales_af(spark, d).withColumn("Sales", F.col("Sales").cast("decimal(18,2)"))
    out = charts.daily_mean(af, "Sales", "Order Date")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"),
                      F.round("mean", 4).cast("double").alias("mean"))


def q_histogram(spark, d):
    out = charts.histogram(sales_af(spark, d), "Sales")
    return out.select("bin", F.round("lower", 4).alias("lower"),
                      F.round("upper", 4).alias("upper"), "count")


def q_box_stats(spark, d):
    out = charts.box_stats(sales_af(spark, d), "Sales")
    return out.select("n", *[F.round(c, 4).alias(c) for c in
                             ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers")


def q_grouped_box_stats(spark, d):
    out = charts.grouped_box_stats(sales_af(spark, d), "Sales", "Category")
    return out.select(F.col("key").alias("category"), "n",
                      *[F.round(c, 4).alias(c) for c in
                        ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers")


def q_thinned_labels(spark, d):
    days = charts.daily_mean(sales_af(spark, d), "Sales", "Order Date") \
        .select(F.date_format("day", "yyyy-MM-dd").alias("day"))
    return charts.thinned_labels(days, "day", ["day"]).select("position", "label", "visible")


# ---------------------------------------------------------------- J, E16-E19, F

def q_threshold_anomaly(spark, d):
    recs = event_series(spark, d)
    out = anomaly.ThresholdModel(threshold=100.0).transform(recs)
    return out.select("entity_id", "value", "is_anomaly")


def q_zscore_anomaly(spark, d):
    recs = order_series(spark, d)
    out = anomaly.ZScoreModel(threshold=2.0).fit(recs).transform(recs)
    return out.select("entity_id", "timestamp", "value", "is_anomaly", "anomaly_score")


def _iqr_scored(spark, d):
    return anomaly.iqr_detect(sales_flat(spark, d))


def q_iqr_anomaly(spark, d):
    return _iqr_scored(spark, d).select("entity_id", "timestamp", "anomaly_score", "is_anomaly")


def q_severity_scored(spark, d):
    return anomaly.severity(_iqr_scored(spark, d)).select(
        "entity_id", "timestamp", "anomaly_score", "severity", "alert")


def q_anomaly_summary(spark, d):
    out = anomaly.evaluation(anomaly.severity(_iqr_scored(spark, d)))
    return out.select("total_records", "anomaly_count", F.round("anomaly_rate", 6).alias("anomaly_rate"))


def q_severity_breakdown(spark, d):
    return anomaly.severity_breakdown(anomaly.severity(_iqr_scored(spark, d)))


def q_score_distribution(spark, d):
    return anomaly.score_distribution(anomaly.severity(_iqr_scored(spark, d)))


def q_linear_trend(spark, d):
    return forecast.linear_trend(order_series(spark, d), ["entity_id"], steps=5).select(
        "entity_id", "timestamp", "value")


def q_moving_average(spark, d):
    return forecast.moving_average(event_series(spark, d), ["entity_id"], steps=5, window=2) \
        .select("entity_id", "timestamp", "value")


def q_future_rows(spark, d):
    pred = forecast.moving_average(event_series(spark, d), ["entity_id"], steps=5, window=2)
    _, counts = validate.future_rows(pred)
    return counts


def q_regression_metrics(spark, d):
    fitted = forecast.linear_trend(order_series(spark, d), ["entity_id"], steps=0, actual="actual")
    return metrics.regression_metrics(fitted, "actual", "value")


def q_classification_metrics(spark, d):
    return metrics.classification_metrics(document_scores(spark, d), "label", "is_anomaly")


def q_roc_auc(spark, d):
    return metrics.roc_auc(document_scores(spark, d), "label", "anomaly_score")


def q_model_comparison(spark, d):
    res = {f"zscore_{t}": metrics.classification_metrics(document_scores(spark, d, t))
           for t in (1.5, 2.0)}
    return metrics.model_comparison("anomaly", res)


def q_kmeans_anomaly(spark, d):
    from sifter.operators.kmeans import KMeansModel
    recs = event_series(spark, d)
    out = KMeansModel(n_clusters=3).fit(recs).transform(recs)
    return out.select("entity_id", "value", "is_anomaly", "anomaly_score")


def q_isolation_forest(spark, d):
    from sifter.operators.forest import IsolationForestModel
    recs = event_series(spark, d)
    out = IsolationForestModel(contamination=0.1).fit(recs).transform(recs)
    return out.select("entity_id", "value", "is_anomaly", "anomaly_score")


def q_validation_report(spark, d):
    totals, _ = validate.batch_validation(dirty_canonical(spark, d, index=False))
    return validate.validation_report(totals)


def q_box_outliers(spark, d):
    ev = table(spark, d, "events").select("event_id", "value")
    return charts.box_outliers(ev, "value", charts.box_stats(ev, "value"))


def q_detector_summary(spark, d):
    recs = order_series(spark, d)
    _, summary = anomaly.ZScoreModel(threshold=2.0).fit(recs).evaluate(recs)
    return summary


def q_iqr_fences(spark, d):
    feats = reshape.derived_metrics(sales_flat(spark, d))
    cols = [f.name for f in feats.schema.fields if f.dataType.typeName() in ("long", "double")]
    fences = anomaly.iqr_fences(feats, cols)
    rows = [(c, lo, hi) for c, (lo, hi) in fences.items()]
    out = spark.createDataFrame(rows, "field string, lower double, upper double")
    return out.select("field", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


def q_profile_filter(spark, d):
    summary = profile.numeric_summary(sales_af(spark, d))
    return profile.filter_fields(summary, [" sales", "PROFIT"]).select(
        "field", "count", "missing", "mean")


def q_anomalous_rows(spark, d):
    recs = event_series(spark, d)
    flagged = anomaly.ThresholdModel(threshold=100.0).transform(recs)
    return validate.anomalous_rows(flagged).select("entity_id", "timestamp", "value")


def q_column_iqr(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    flagged, _ = anomaly.column_fence_flags(orders, "o_totalprice")
    return flagged.select("o_orderkey", "o_totalprice", "is_anomaly")


# ---------------------------------------------------------------- rows with gaps

def gappy_sales(spark, d) -> DataFrame:
    """Line items with gaps: null quantity (order % 3 = 0), NaN discount
    (order % 4 = 1), null category (order % 5 = 1)."""
    i = F.col("order_id")
    return sales_raw(spark, d).select(
        "order_id", "order_date", "sales",
        F.when(i % 3 != 0, F.col("quantity")).alias("quantity"),
        F.when(i % 4 == 1, F.lit(float("nan"))).otherwise(F.col("discount")).alias("discount"),
        F.when(i % 5 != 1, F.col("category")).alias("category"), "profit")


def q_derived_metrics_gaps(spark, d):
    out = reshape.derived_metrics(reshape.flatten(reshape.adapt(gappy_sales(spark, d))))
    return out.select("entity_id", "timestamp", "feature_count",
                      F.round("feature_sum", 4).alias("feature_sum"))


def q_missing_by_field(spark, d):
    flat = reshape.flatten(reshape.adapt(gappy_sales(spark, d)))
    return profile.missing_by_field(reshape.analysis_frame(flat))


def q_complete_pairs(spark, d):
    raw = gappy_sales(spark, d).select("order_id", "discount", "category")
    return validate.drop_missing_pairs(raw, ["discount", "category"])


def q_sanitized(spark, d):
    i, v = F.col("event_id"), F.col("value")
    raw = table(spark, d, "events").select(
        "event_id", F.when(i % 11 == 4, F.lit(float("nan"))).when(i % 11 == 5, F.lit(float("-inf"))).otherwise(v).alias("value"))
    return validate.sanitize(raw, 2)


def q_usable_records(spark, d):
    return reshape.keep_usable(reshape.model_records(dirty_canonical(spark, d, index=False)))


def q_required_fields(spark, d):
    i = F.col("event_id")
    entries = F.create_map(
        F.lit("timestamp"), F.when(i % 7 != 3, F.col("ts").cast("string")),
        F.lit("source"), F.when(i % 9 != 2, F.col("user_id").cast("string")),
        F.lit("event_type"), F.when(i % 5 != 1, F.col("event_type")))
    raw = table(spark, d, "events").select("event_id", F.map_filter(entries, lambda k, v: v.isNotNull()).alias("record"))
    return raw.select("event_id", validate.required_fields_present().alias("complete"))


def q_flatten_metadata(spark, d):
    ev = table(spark, d, "events").withColumnRenamed("ts", "event_time")
    meta = F.when(F.col("entity_id") % 2 == 0, F.create_map(F.lit("kind"), F.col("features.event_type"))) \
        .otherwise(F.create_map(F.lit("seen"), F.col("timestamp")))
    return reshape.flatten_with_metadata(reshape.adapt(ev).withColumn("metadata", meta))


def q_forecast_summary(spark, d):
    return forecast.forecast_summary(
        forecast.moving_average(event_series(spark, d), ["entity_id"], steps=5, window=2))


def q_kmeans_scores(spark, d):
    from sifter.operators.kmeans import KMeansModel
    recs = event_series(spark, d)
    out = KMeansModel(centres=[0.0, 50.0, 100.0]).calibrate(recs).transform(recs)
    return out.select("entity_id", "value", "is_anomaly", "anomaly_score")


# ---------------------------------------------------------------- scalar and alignment rows

def q_date_parse(spark, d):
    """Order dates as texts of three forms and one that is no date."""
    from sifter.functions.cols import iso_string, try_timestamp
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")) \
        .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    rows = o.select("o_orderkey", text.alias("t"))
    parsed = try_timestamp(F.col("t"), rows.schema["t"].dataType)
    return rows.withColumn("ts", parsed).select("o_orderkey", iso_string(F.col("ts"), T.TimestampType()).alias("parsed"))


def q_short_labels(spark, d):
    """I5 over the names of the customers with their segments."""
    from sifter.functions.cols import truncate_label
    c = table(spark, d, "customer")
    return c.select("c_custkey", truncate_label(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("label"))


def q_aligned(spark, d):
    """The i-th order beside the i-th score of the orders, scored elsewhere."""
    recs = with_ordinal(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value")), ["o_orderkey"])
    scored = anomaly.ZScoreModel(threshold=2.0).fit(recs).transform(recs).select("record_index", "anomaly_score")
    return metrics.align(recs, scored).select("record_index", "o_orderkey", "pred_anomaly_score")


def q_expanded_lists(spark, d):
    """Conversations as one column of lists, expanded to their turns."""
    from sifter.sources.readers import expand_single_container
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("conv_id", "turn", "role")).alias("turns"))
    return expand_single_container(talks.select("turns"))


# ---------------------------------------------------------------- K1-K6, E8, J10

def stored_run(spark, d):
    """K1 over the dirty events: (run summary, path of the Parquet store)."""
    from uuid import uuid4

    from sifter.plans.pipeline import run_pipeline
    from sifter.session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark)}/sifter-run-{uuid4().hex}"
    dirty_events(spark, d, index=False).write.parquet(f"{base}/source")
    summary = run_pipeline(spark, f"{base}/source", f"{base}/store", "parquet", "parquet", mode="local")
    if summary.status != "SUCCESS":
        raise RuntimeError(f"{summary.failed_stage}: {summary.error_message}")
    return summary, f"{base}/store"


def q_run_metrics(spark, d):
    from sifter.plans.pipeline import run_breakdown
    from sifter.sources import store
    summary, path = stored_run(spark, d)
    metrics, breakdown = run_breakdown(spark, summary)
    names = ["records_ingested", "records_valid", "records_invalid", "records_persisted"]
    rows = metrics.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("count")) for n in names])))
    kept = store.stored_metadata(spark, path).select(F.lit("stored").alias("metric"), F.col("record_count").alias("count"))
    return rows.unionByName(breakdown.withColumnRenamed("status", "metric")).unionByName(kept)


def q_model_ready(spark, d):
    from sifter.plans.pipeline import model_ready
    rows, _ = model_ready(spark, stored_run(spark, d)[1], "parquet")
    return rows.select("entity_id", "timestamp", "value")


def q_model_ready_counts(spark, d):
    from sifter.plans.pipeline import model_ready
    return model_ready(spark, stored_run(spark, d)[1], "parquet")[1]


def q_detector_run(spark, d):
    from sifter.plans.pipeline import detect, model_ready
    rows, summary, context = detect(model_ready(spark, stored_run(spark, d)[1], "parquet")[0], "zscore", threshold=1.5)
    return summary.withColumn("value_field", F.lit(context["value"]))


def q_overview_document(spark, d):
    doc = profile.overview_document(sales_flat(spark, d), {"source_name": "lineitem"})
    fact = lambda part, field, metric, value: F.struct(F.lit(part).alias("part"), field.alias("field"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    each = lambda part, metrics: F.flatten(F.transform(part, lambda x: F.array(*[fact(part, x["field"], m, x[m]) for m in metrics])))
    whole = F.array(*[fact("table", F.lit(""), m, F.col(m)) for m in ("rows", "columns")])
    tops = F.flatten(F.transform("categories", lambda x: F.transform(x["top"], lambda t: F.struct(
        F.lit("top").alias("part"), F.concat_ws(":", x["field"], t["value"]).alias("field"), F.lit("count").alias("metric"), t["count"].cast("double").alias("value")))))
    charts_ = F.flatten(F.transform(F.map_entries("charts"), lambda c: F.transform(F.map_keys(c["value"]), lambda v: F.struct(
        F.concat(F.lit("chart:"), c["key"]).alias("part"), c["value"][v].alias("field"), v.alias("metric"), F.lit(1.0).alias("value")))))
    return doc.select(F.inline(F.concat(
        whole, each("numeric", ("count", "missing", "min", "max", "mean", "median", "std")), each("dates", ("count", "missing")),
        each("categories", ("count", "missing", "unique")), tops, charts_)))


def q_relationship_boxes(spark, d):
    """E15's grouped boxes of both compare variables, from shared scans."""
    swept = charts.relationship_sweep(sales_af(spark, d).withColumn("record_index", F.lit(0)), "Sales", ["Category", "Quantity", "Absent"])
    out = swept["grouped_box"]
    return out.select("variable", "key", "n", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers")


def q_chart_data(spark, d):
    from sifter.plans.pipeline import chart_data
    flat = sales_flat(spark, d)
    bars = chart_data(flat, "bar-category", compare="Category").select(F.lit("bar-category").alias("chart"), "value", F.col("count").cast("double").alias("number"))
    means = chart_data(flat, "grouped-comparison", compare="Category")
    exact = flat.withColumn("sales", F.col("sales").cast("decimal(18,2)"))  # a mean that no order of additions changes
    days = chart_data(exact, "time-line", compare="Order Date")
    return bars.unionByName(means.select(F.lit("grouped-comparison").alias("chart"), F.col(means.columns[0]).alias("value"), F.round("mean", 4).alias("number"))) \
        .unionByName(days.select(F.lit("time-line").alias("chart"), F.col(days.columns[0]).cast("string").alias("value"), F.round("mean", 4).cast("double").alias("number")))


#: a forest for the query below: breakpoints, a score per interval, offset
GIVEN_FOREST = {"psi": 256, "splits": [5.0, 50.0, 95.0, 140.0], "scores": [-0.7, -0.5, -0.4, -0.45, -0.8], "offset": -0.55}


def q_forest_scores(spark, d):
    from sifter.operators.forest import IsolationForestModel
    recs = table(spark, d, "events").select(F.col("event_id").alias("entity_id"), "value")
    return IsolationForestModel().restore(spark, GIVEN_FOREST).transform(recs).select(
        "entity_id", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


def q_stored_detector(spark, d):
    """Fitted on the orders, stored as a row, applied to the line items."""
    from sifter.operators import detectors
    orders = table(spark, d, "orders").select(F.col("o_totalprice").alias("value"))
    kept = detectors.to_frame(spark, anomaly.ZScoreModel(threshold=1.0).fit(orders))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    return detectors.from_frame(kept).transform(items).select("l_orderkey", "l_linenumber", "is_anomaly", "anomaly_score")


QUERIES = {
    "run_metrics": q_run_metrics,
    "model_ready": q_model_ready,
    "model_ready_counts": q_model_ready_counts,
    "detector_run": q_detector_run,
    "overview_document": q_overview_document,
    "chart_data": q_chart_data,
    "date_parse": q_date_parse,
    "short_labels": q_short_labels,
    "aligned": q_aligned,
    "expanded_lists": q_expanded_lists,
    "standard_cleaning_audit": q_standard_cleaning_audit,
    "heavy_values": q_heavy_values,
    "relationship_boxes": q_relationship_boxes,
    "forest_scores": q_forest_scores,
    "stored_detector": q_stored_detector,
    "derived_metrics_gaps": q_derived_metrics_gaps,
    "missing_by_field": q_missing_by_field,
    "complete_pairs": q_complete_pairs,
    "sanitized": q_sanitized,
    "usable_records": q_usable_records,
    "required_fields": q_required_fields,
    "flatten_metadata": q_flatten_metadata,
    "forecast_summary": q_forecast_summary,
    "kmeans_scores": q_kmeans_scores,
    "adapt_canonical": q_adapt_canonical,
    "flatten_canonical": q_flatten_canonical,
    "derived_metrics": q_derived_metrics,
    "minmax_normalise": q_minmax_normalise,
    "first_numeric_value": q_first_numeric_value,
    "feature_dataset": q_feature_dataset,
    "scatter_encoded": q_scatter_encoded,
    "validate_records": q_validate_records,
    "invalid_reasons": q_invalid_reasons,
    "batch_validation": q_batch_validation,
    "batch_invalid_rows": q_batch_invalid_rows,
    "timestamp_check": q_timestamp_check,
    "feature_check": q_feature_check,
    "duplicates": q_duplicates,
    "quality_report": q_quality_report,
    "entity_lookup": q_entity_lookup,
    "cleaning_audit": q_cleaning_audit,
    "numeric_summary": q_numeric_summary,
    "date_summary": q_date_summary,
    "categorical_summary": q_categorical_summary,
    "top_values": q_top_values,
    "missing_by_column": q_missing_by_column,
    "shape": q_shape,
    "target_stats": q_target_stats,
    "category_counts": q_category_counts,
    "grouped_mean": q_grouped_mean,
    "daily_mean": q_daily_mean,
    "histogram": q_histogram,
    "box_stats": q_box_stats,
    "grouped_box_stats": q_grouped_box_stats,
    "thinned_labels": q_thinned_labels,
    "threshold_anomaly": q_threshold_anomaly,
    "zscore_anomaly": q_zscore_anomaly,
    "iqr_anomaly": q_iqr_anomaly,
    "severity_scored": q_severity_scored,
    "anomaly_summary": q_anomaly_summary,
    "severity_breakdown": q_severity_breakdown,
    "score_distribution": q_score_distribution,
    "linear_trend": q_linear_trend,
    "moving_average": q_moving_average,
    "future_rows": q_future_rows,
    "regression_metrics": q_regression_metrics,
    "classification_metrics": q_classification_metrics,
    "roc_auc": q_roc_auc,
    "model_comparison": q_model_comparison,
    "validation_report": q_validation_report,
    "box_outliers": q_box_outliers,
    "detector_summary": q_detector_summary,
    "iqr_fences": q_iqr_fences,
    "profile_filter": q_profile_filter,
    "anomalous_rows": q_anomalous_rows,
    "column_iqr": q_column_iqr,
    "kmeans_anomaly": q_kmeans_anomaly,
    "isolation_forest": q_isolation_forest,
}
