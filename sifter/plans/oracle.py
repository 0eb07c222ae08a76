"""DuckDB SQL for each named query: an independent statement of the same
semantics over the same tables, used as the correctness oracle.

Conventions shared with the Spark side:
* timestamps render as ISO-8601, with microseconds only when non-zero;
* rounding is half-up on the shortest decimal form (Spark's ``round``),
  written here as a DECIMAL round.
"""

from __future__ import annotations


def ISO(x: str) -> str:
    return (f"CASE WHEN strftime({x}, '%f') = '000000' THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END")


def RND(x: str, d: int = 4) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {d}) AS DOUBLE)"


ISO_RE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"

EV_IDX = "ev_idx AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS record_index FROM events)"

DIRTY = EV_IDX + f""",
dirty AS (
  SELECT record_index,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS entity_id,
         CASE WHEN event_id % 7 = 3 THEN NULL ELSE {ISO('ts')} END AS timestamp,
         CASE WHEN event_id % 5 = 1 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 11 = 4 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
         CASE WHEN event_id % 9 = 2 THEN NULL ELSE props END AS props
  FROM ev_idx)"""

HOURLY = EV_IDX + f""",
hourly AS (
  SELECT record_index,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS entity_id,
         CASE WHEN event_id % 7 = 3 THEN NULL ELSE {ISO("date_trunc('hour', ts)")} END AS timestamp,
         event_type, value
  FROM ev_idx)"""

SALES = """sales AS (
  SELECT l_orderkey AS entity_id, l_shipdate AS order_date, l_extendedprice AS sales,
         l_quantity AS quantity, l_discount AS discount, l_returnflag AS category,
         l_extendedprice * (0.1 - l_discount) AS profit
  FROM lineitem)"""

SALES_DM = SALES + """,
sales_dm AS (
  SELECT *, 5 AS feature_count,
         CAST(entity_id AS DOUBLE) + sales + quantity + discount + profit AS feature_sum
  FROM sales)"""


def _numeric_summary() -> str:
    parts = []
    for label, col in (("Sales", "sales"), ("Profit", "profit"), ("Quantity", "quantity"),
                       ("Discount", "discount")):
        parts.append(f"""SELECT '{label}' AS field, count({col}) AS count,
           count(*) - count({col}) AS missing, {RND(f'min({col})')} AS min,
           {RND(f'max({col})')} AS max, {RND(f'avg({col})')} AS mean,
           {RND(f'quantile_cont({col}, 0.5)')} AS median,
           {RND(f'CASE WHEN count({col}) > 1 THEN stddev_samp({col}) END')} AS std
    FROM sales""")
    return f"WITH {SALES} " + " UNION ALL ".join(parts)


def _overview_document() -> str:
    parts = ["SELECT 'table' AS part, '' AS field, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM sales",
             "SELECT 'table', '', 'columns', 7.0 FROM (SELECT 1)"]
    for label, col in (("Sales", "sales"), ("Profit", "profit"), ("Quantity", "quantity"), ("Discount", "discount")):
        for metric, expr in (("count", f"count({col})"), ("missing", f"count(*) - count({col})"), ("min", RND(f"min({col})")), ("max", RND(f"max({col})")),
                             ("mean", RND(f"avg({col})")), ("median", RND(f"quantile_cont({col}, 0.5)")), ("std", RND(f"stddev_samp({col})"))):
            parts.append(f"SELECT 'numeric', '{label}', '{metric}', CAST({expr} AS DOUBLE) FROM sales")
    for metric, expr in (("count", "count(order_date)"), ("missing", "count(*) - count(order_date)")):
        parts.append(f"SELECT 'dates', 'Order Date', '{metric}', CAST({expr} AS DOUBLE) FROM sales")
    for metric, expr in (("count", "count(category)"), ("missing", "count(*) - count(category)"), ("unique", "count(DISTINCT category)")):
        parts.append(f"SELECT 'categories', 'Category', '{metric}', CAST({expr} AS DOUBLE) FROM sales")
    parts.append("""SELECT 'top', 'Category:' || category, 'count', CAST(n AS DOUBLE) FROM (
  SELECT category, count(*) AS n FROM sales WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 10)""")
    for chart in ("histogram", "boxplot", "scatter", "grouped-comparison", "grouped-boxplot", "time-line"):
        parts.append(f"SELECT 'chart:{chart}', 'Sales', 'target_variable', 1.0 FROM (SELECT 1)")
    for chart in ("bar-category", "scatter", "grouped-comparison", "grouped-boxplot"):
        parts.append(f"SELECT 'chart:{chart}', 'Profit', 'compare_variable', 1.0 FROM (SELECT 1)")
    parts.append("SELECT 'chart:time-line', 'Order Date', 'compare_variable', 1.0 FROM (SELECT 1)")
    return f"WITH {SALES} " + " UNION ALL ".join(parts)


def _iqr_scored() -> str:
    cols = ["entity_id", "sales", "quantity", "discount", "profit", "feature_count", "feature_sum"]
    fences = ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in cols)
    score = " + ".join(f"CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN 1.0 ELSE 0.0 END" for c in cols)
    return f"""WITH {SALES_DM},
f AS (SELECT {fences} FROM sales_dm),
scored AS (
  SELECT entity_id, {ISO('order_date')} AS timestamp, CAST({score} AS DOUBLE) AS anomaly_score
  FROM sales_dm, f),
sev AS (
  SELECT *, anomaly_score > 0 AS is_anomaly,
         CASE WHEN anomaly_score >= 3 THEN 'critical' WHEN anomaly_score >= 2 THEN 'high'
              WHEN anomaly_score >= 1 THEN 'medium' ELSE 'low' END AS severity,
         CASE WHEN anomaly_score > 0 THEN 'ALERT' ELSE 'OK' END AS alert
  FROM scored)"""


def _box(group: bool) -> str:
    key = "category, " if group else ""
    grp = "GROUP BY category" if group else ""
    join_on = "USING (category)" if group else "ON true"
    return f"""WITH {SALES},
q AS (SELECT {key}count(*) AS n, quantile_cont(sales, 0.25) AS q1,
             quantile_cont(sales, 0.5) AS median, quantile_cont(sales, 0.75) AS q3
      FROM sales {grp}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q),
w AS (SELECT {key}least(coalesce(min(sales) FILTER (WHERE sales >= lo_f), min(q1)), min(q1)) AS wl,
             greatest(coalesce(max(sales) FILTER (WHERE sales <= hi_f), min(q3)), min(q3)) AS wh
      FROM sales JOIN f {join_on} {grp}),
o AS (SELECT {key}count(*) FILTER (WHERE sales < wl OR sales > wh) AS outliers
      FROM sales JOIN w {join_on} {grp})
SELECT {key}n, {RND('q1')} AS q1, {RND('median')} AS median, {RND('q3')} AS q3,
       {RND('wl')} AS whisker_low, {RND('wh')} AS whisker_high, outliers
FROM f JOIN w {join_on} JOIN o {join_on}"""


def _boxes(*variables: tuple[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{label}' AS variable, CAST({col} AS VARCHAR) AS key, sales FROM sales WHERE {col} IS NOT NULL AND sales IS NOT NULL"
                              for label, col in variables)
    return f"""WITH {SALES},
v AS ({rows}),
q AS (SELECT variable, key, count(*) AS n, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.5) AS median, quantile_cont(sales, 0.75) AS q3
      FROM v GROUP BY ALL),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q),
w AS (SELECT variable, key, least(coalesce(min(sales) FILTER (WHERE sales >= lo_f), min(q1)), min(q1)) AS wl,
             greatest(coalesce(max(sales) FILTER (WHERE sales <= hi_f), min(q3)), min(q3)) AS wh FROM v JOIN f USING (variable, key) GROUP BY ALL),
o AS (SELECT variable, key, count(*) FILTER (WHERE sales < wl OR sales > wh) AS outliers FROM v JOIN w USING (variable, key) GROUP BY ALL)
SELECT variable, key, n, {RND('q1')} AS q1, {RND('median')} AS median, {RND('q3')} AS q3,
       {RND('wl')} AS whisker_low, {RND('wh')} AS whisker_high, outliers
FROM f JOIN w USING (variable, key) JOIN o USING (variable, key)"""


def _docs(threshold: float) -> str:
    return f"""st AS (SELECT avg(CAST(n_chars AS DOUBLE)) AS m, stddev_pop(CAST(n_chars AS DOUBLE)) AS s
            FROM documents),
sc AS (SELECT d.doc_id, abs((CAST(n_chars AS DOUBLE) - m) / s) AS z FROM documents d, st),
lab AS (SELECT sc.doc_id, z, z > {threshold} AS flag, l.toxic AS label
        FROM sc LEFT JOIN labels l USING (doc_id))"""


def _classification(threshold: float) -> str:
    return f"""WITH {_docs(threshold)},
c AS (SELECT count(*) AS support,
             count(*) FILTER (WHERE label = 1 AND flag) AS tp,
             count(*) FILTER (WHERE label = 0 AND flag) AS fp,
             count(*) FILTER (WHERE label = 0 AND NOT flag) AS tn,
             count(*) FILTER (WHERE label = 1 AND NOT flag) AS fn
      FROM lab WHERE label IS NOT NULL),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM c)
SELECT CASE WHEN support = 0 THEN NULL ELSE {RND('p')} END AS precision,
       CASE WHEN support = 0 THEN NULL ELSE {RND('rc')} END AS recall,
       CASE WHEN support = 0 THEN NULL ELSE
         {RND('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END')} END AS f1_score,
       support, tp AS true_positives, fp AS false_positives, tn AS true_negatives,
       fn AS false_negatives
FROM r"""


def _trend_fit() -> str:
    return """t AS (SELECT o_orderkey, o_orderdate, o_totalprice AS y,
                row_number() OVER (ORDER BY o_orderkey) - 1 AS x
         FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)),
fit AS (SELECT count(*) AS n, regr_slope(y, CAST(x AS DOUBLE)) AS slope,
               regr_intercept(y, CAST(x AS DOUBLE)) AS icpt FROM t)"""


GAPPY = """gappy AS (
  SELECT l_orderkey AS entity_id, l_shipdate AS order_date, l_extendedprice AS sales,
         CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END AS quantity,
         CASE WHEN l_orderkey % 4 <> 1 THEN l_discount END AS discount,
         CASE WHEN l_orderkey % 5 <> 1 THEN l_returnflag END AS category,
         l_extendedprice * (0.1 - l_discount) AS profit
  FROM lineitem)"""


ORACLE: dict[str, str] = {
    "derived_metrics_gaps": f"""
WITH {GAPPY}
SELECT entity_id, {ISO('order_date')} AS timestamp,
       CAST((entity_id IS NOT NULL)::INT + (sales IS NOT NULL)::INT + (quantity IS NOT NULL)::INT
            + (discount IS NOT NULL)::INT + (profit IS NOT NULL)::INT AS BIGINT) AS feature_count,
       {RND('coalesce(CAST(entity_id AS DOUBLE), 0) + coalesce(sales, 0) + coalesce(quantity, 0) + coalesce(discount, 0) + coalesce(profit, 0)')} AS feature_sum
FROM gappy""",

    "missing_by_field": f"WITH {GAPPY} " + " UNION ALL ".join(
        f"SELECT '{label}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM gappy"
        for label, c in (("Sales", "sales"), ("Profit", "profit"), ("Quantity", "quantity"),
                         ("Discount", "discount"), ("Category", "category"), ("Order Date", "order_date"))),

    "complete_pairs": f"""
WITH {GAPPY}
SELECT entity_id AS order_id, discount, category FROM gappy
WHERE discount IS NOT NULL AND category IS NOT NULL""",

    "sanitized": f"""
SELECT event_id, CASE WHEN event_id % 11 NOT IN (4, 5) AND NOT isnan(value) THEN {RND('value', 2)} END AS value
FROM events""",

    "usable_records": f"""
WITH {DIRTY}
SELECT CAST(entity_id AS VARCHAR) AS entity_id, timestamp, value FROM dirty
WHERE value IS NOT NULL AND NOT isnan(value)""",

    "required_fields": """
SELECT event_id, event_id % 7 <> 3 AND event_id % 9 <> 2 AND event_id % 5 <> 1
       AND ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL AS complete
FROM events""",

    "flatten_metadata": f"""
SELECT event_id AS entity_id, {ISO('ts')} AS timestamp, event_type, value, props,
       CASE WHEN event_id % 2 = 0 THEN event_type END AS meta_kind,
       CASE WHEN event_id % 2 <> 0 THEN {ISO('ts')} END AS meta_seen
FROM events""",

    "forecast_summary": """
SELECT count(*) + 5 AS total_records, CAST(0 AS BIGINT) AS anomaly_count FROM events""",

    "run_metrics": f"""
WITH {DIRTY},
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL) AS v FROM dirty)
SELECT unnest(['records_ingested', 'records_valid', 'records_invalid', 'records_persisted', 'valid', 'invalid', 'stored']) AS metric,
       unnest([n, v, n - v, v, v, n - v, v]) AS count FROM c""",

    "model_ready": f"""
WITH {DIRTY}
SELECT CAST(entity_id AS VARCHAR) AS entity_id, timestamp, value FROM dirty
WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)""",

    "model_ready_counts": f"""
WITH {DIRTY},
c AS (SELECT count(*) AS n FROM dirty
      WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL AND value IS NOT NULL AND NOT isnan(value))
SELECT n AS total_records, n AS valid_records, CAST(0 AS BIGINT) AS invalid_records FROM c""",

    "detector_run": f"""
WITH {DIRTY},
r AS (SELECT value FROM dirty WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
t AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM r)
SELECT count(*) AS total_records, count(*) FILTER (WHERE abs((value - m) / s) > 1.5) AS anomaly_count, 'value' AS value_field FROM r, t""",

    "overview_document": _overview_document(),

    "chart_data": f"""
SELECT 'bar-category' AS chart, l_returnflag AS value, CAST(count(*) AS DOUBLE) AS number FROM lineitem
WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
UNION ALL
SELECT 'grouped-comparison', l_returnflag, {RND('avg(l_extendedprice)')} FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_returnflag
UNION ALL
SELECT 'time-line', strftime(l_shipdate, '%Y-%m-%d'), {RND('avg(CAST(l_extendedprice AS DECIMAL(18,2)))')}
FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY strftime(l_shipdate, '%Y-%m-%d')""",

    "date_parse": f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN {ISO('CAST(o_orderdate AS TIMESTAMP)')} END AS parsed FROM orders""",

    "short_labels": """
WITH l AS (SELECT c_custkey, c_name || ' ' || c_mktsegment AS t FROM customer)
SELECT c_custkey, CASE WHEN length(t) > 18 THEN substr(t, 1, 17) || '…' ELSE t END AS label FROM l""",

    "aligned": f"""
WITH t AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS record_index, o_orderkey,
       {RND('abs((o_totalprice - m) / s)')} AS pred_anomaly_score FROM orders, t""",

    "expanded_lists": "SELECT conv_id, turn, role FROM conversations",

    "heavy_values": """
SELECT * FROM (SELECT 'source' AS field, source AS value, count(*) AS count FROM documents
               WHERE source IS NOT NULL GROUP BY source ORDER BY count DESC, value LIMIT 10)
UNION ALL
SELECT 'l_orderkey', CAST(value AS VARCHAR), count FROM (
  SELECT l_orderkey AS value, count(*) AS count FROM lineitem WHERE l_orderkey IS NOT NULL
  GROUP BY l_orderkey ORDER BY count DESC, value LIMIT 10)""",

    "relationship_boxes": _boxes(("Category", "category"), ("Quantity", "quantity")),

    "forest_scores": f"""
WITH x AS (SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE value END AS v FROM events),
s AS (SELECT event_id, CASE WHEN v < 5 THEN -0.7 WHEN v < 50 THEN -0.5 WHEN v < 95 THEN -0.4 WHEN v < 140 THEN -0.45 ELSE -0.8 END::DOUBLE + 0.55::DOUBLE AS d FROM x)
SELECT event_id AS entity_id, d < 0 AS is_anomaly, {RND('d', 6)} AS anomaly_score FROM s""",

    "stored_detector": f"""
WITH t AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)
SELECT l_orderkey, l_linenumber, coalesce(abs((l_extendedprice - m) / s) > 1.0, false) AS is_anomaly,
       {RND('abs((l_extendedprice - m) / s)')} AS anomaly_score FROM lineitem, t""",

    "kmeans_scores": f"""
WITH d AS (SELECT event_id, value, least(abs(x), abs(x - 50.0), abs(x - 100.0)) AS dist
           FROM (SELECT event_id, value, CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE value END AS x
                 FROM events)),
t AS (SELECT avg(dist) + 2 * stddev_pop(dist) AS level FROM d)
SELECT event_id AS entity_id, value, dist > level AS is_anomaly, {RND('dist', 6)} AS anomaly_score
FROM d, t""",

    "adapt_canonical": f"""
SELECT o_orderkey AS entity_id, {ISO('o_orderdate')} AS timestamp, o_custkey, o_orderstatus,
       o_totalprice, o_orderpriority, CAST(0 AS INTEGER) AS metadata_size
FROM orders""",

    "flatten_canonical": f"""
SELECT event_id AS entity_id, {ISO('ts')} AS timestamp, event_type, value, props FROM events""",

    "derived_metrics": f"""
WITH {SALES_DM}
SELECT entity_id, {ISO('order_date')} AS timestamp, CAST(feature_count AS BIGINT) AS feature_count,
       {RND('feature_sum')} AS feature_sum
FROM sales_dm""",

    "minmax_normalise": f"""
WITH s AS (SELECT CAST(min(p_size) AS DOUBLE) AS mn1, CAST(max(p_size) AS DOUBLE) AS mx1,
                  min(p_retailprice) AS mn2, max(p_retailprice) AS mx2 FROM part)
SELECT p_partkey, {RND('(CAST(p_size AS DOUBLE) - mn1) / (mx1 - mn1)', 6)} AS p_size,
       {RND('(p_retailprice - mn2) / (mx2 - mn2)', 6)} AS p_retailprice
FROM part, s""",

    "first_numeric_value": f"""
SELECT event_id AS entity_id, {ISO('ts')} AS timestamp,
       CASE event_id % 4 WHEN 1 THEN CAST(user_id AS DOUBLE)
                         WHEN 2 THEN CAST(user_id * 10 AS DOUBLE)
                         ELSE value END AS value
FROM events""",

    "feature_dataset": f"""
WITH {DIRTY},
v AS (SELECT entity_id IS NOT NULL AND timestamp IS NOT NULL AND value IS NOT NULL
             AND NOT isnan(value) AS ok FROM dirty)
SELECT count(*) AS total_records, count(*) FILTER (WHERE ok) AS valid_records,
       count(*) FILTER (WHERE NOT ok) AS invalid_records
FROM v""",

    "scatter_encoded": f"""
WITH {EV_IDX},
f AS (SELECT event_type, min(record_index) AS first_idx FROM ev_idx GROUP BY event_type),
c AS (SELECT event_type, row_number() OVER (ORDER BY first_idx) - 1 AS code FROM f)
SELECT record_index, value AS x, CAST(code AS BIGINT) AS y
FROM ev_idx JOIN c USING (event_type)
WHERE value IS NOT NULL AND NOT isnan(value)""",

    "validate_records": f"""
WITH {DIRTY}
SELECT record_index, CAST(entity_id AS VARCHAR) AS entity_id, timestamp,
       CASE WHEN entity_id IS NULL OR timestamp IS NULL THEN 'invalid' ELSE 'valid' END AS status,
       CAST(CAST(entity_id IS NULL AS INTEGER) + CAST(timestamp IS NULL AS INTEGER) AS INTEGER) AS n_errors,
       concat_ws('|', CASE WHEN entity_id IS NULL THEN 'Missing entity_id' END,
                      CASE WHEN timestamp IS NULL THEN 'Missing timestamp' END) AS errors
FROM dirty""",

    "invalid_reasons": f"""
WITH {DIRTY},
r AS (SELECT 'Missing entity_id' AS reason FROM dirty WHERE entity_id IS NULL
      UNION ALL SELECT 'Missing timestamp' FROM dirty WHERE timestamp IS NULL)
SELECT reason, count(*) AS count FROM r GROUP BY reason""",

    "batch_validation": f"""
WITH {DIRTY},
c AS (SELECT count(*) AS total_records,
             count(*) FILTER (WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL) AS valid_records,
             count(*) FILTER (WHERE entity_id IS NULL OR timestamp IS NULL) AS invalid_records
      FROM dirty)
SELECT *, CASE WHEN invalid_records > 0 THEN 'invalid' ELSE 'valid' END AS status FROM c""",

    "batch_invalid_rows": f"""
WITH {DIRTY}
SELECT record_index,
       concat_ws('|', CASE WHEN entity_id IS NULL THEN 'Missing entity_id' END,
                      CASE WHEN timestamp IS NULL THEN 'Missing timestamp' END) AS errors
FROM dirty WHERE entity_id IS NULL OR timestamp IS NULL""",

    "timestamp_check": f"""
WITH j AS (
  SELECT event_id,
         CASE WHEN event_id % 13 = 1 THEN strftime(ts, '%Y%m%d')
              WHEN event_id % 13 = 2 THEN NULL
              WHEN event_id % 13 = 3 THEN 'not a date'
              WHEN event_id % 13 = 4 THEN strftime(ts, '%Y-%m-%d %H:%M')
              WHEN event_id % 13 = 5 THEN strftime(ts, '%Y-%m-%d')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts_text
  FROM events)
SELECT event_id, ts_text,
       CASE WHEN ts_text IS NOT NULL AND regexp_full_match(ts_text, '{ISO_RE}') THEN 'valid'
            ELSE 'invalid' END AS status,
       CASE WHEN ts_text IS NULL THEN 'Missing timestamp'
            WHEN regexp_full_match(ts_text, '{ISO_RE}') THEN ''
            ELSE 'Invalid timestamp format' END AS errors
FROM j""",

    "feature_check": f"""
WITH {DIRTY},
e AS (SELECT record_index,
             concat_ws('|', CASE WHEN event_type IS NULL THEN 'Feature ''event_type'' is missing a value' END,
                            CASE WHEN value IS NULL THEN 'Feature ''value'' is missing a value' END,
                            CASE WHEN props IS NULL THEN 'Feature ''props'' is missing a value' END) AS errors
      FROM dirty)
SELECT record_index, CASE WHEN errors = '' THEN 'valid' ELSE 'invalid' END AS status, errors FROM e""",

    "duplicates": f"""
WITH {HOURLY},
k AS (SELECT record_index, entity_id, timestamp,
             row_number() OVER (PARTITION BY entity_id, timestamp ORDER BY record_index) AS rn
      FROM hourly WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL)
SELECT record_index, entity_id, timestamp FROM k WHERE rn > 1""",

    "quality_report": f"""
WITH {HOURLY},
k AS (SELECT row_number() OVER (PARTITION BY entity_id, timestamp ORDER BY record_index) AS rn
      FROM hourly WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL),
d AS (SELECT count(*) FILTER (WHERE rn > 1) AS dups FROM k),
c AS (SELECT count(*) AS n,
             count(*) FILTER (WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL) AS v
      FROM hourly)
SELECT 'validation' AS pipeline_stage,
       CASE WHEN n - v > 0 THEN 'invalid' ELSE 'valid' END AS dataset_status,
       n AS records_processed, v AS valid_records, n - v AS invalid_records,
       dups AS duplicate_records,
       CASE WHEN dups > 0 THEN 'Duplicate records detected' ELSE '' END AS warnings
FROM c, d""",

    "entity_lookup": f"""
WITH {HOURLY}
SELECT entity_id, timestamp, value FROM hourly WHERE entity_id = 42""",

    "cleaning_audit": f"""
WITH {HOURLY},
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, timestamp ORDER BY record_index) AS rn
      FROM hourly WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL),
after AS (SELECT * FROM k WHERE rn = 1),
b AS (
  SELECT 'rows' AS metric, '' AS field, count(*) AS before FROM hourly
  UNION ALL SELECT 'missing', 'entity_id', count(*) FILTER (WHERE entity_id IS NULL) FROM hourly
  UNION ALL SELECT 'missing', 'timestamp', count(*) FILTER (WHERE timestamp IS NULL) FROM hourly
  UNION ALL SELECT 'missing', 'event_type', count(*) FILTER (WHERE event_type IS NULL) FROM hourly
  UNION ALL SELECT 'missing', 'value', count(*) FILTER (WHERE value IS NULL OR isnan(value)) FROM hourly
  UNION ALL SELECT 'duplicates', '', count(*) FILTER (WHERE rn > 1) FROM k
  UNION ALL SELECT 'invalid_rows', '', count(*) FILTER (WHERE entity_id IS NULL OR timestamp IS NULL) FROM hourly
  UNION ALL SELECT 'valid_rows', '', count(*) FILTER (WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL) FROM hourly
  UNION ALL SELECT 'invalid_reason', 'Missing entity_id', count(*) FROM hourly WHERE entity_id IS NULL
  UNION ALL SELECT 'invalid_reason', 'Missing timestamp', count(*) FROM hourly WHERE timestamp IS NULL),
a AS (
  SELECT 'rows' AS metric, '' AS field, count(*) AS after FROM after
  UNION ALL SELECT 'missing', 'entity_id', count(*) FILTER (WHERE entity_id IS NULL) FROM after
  UNION ALL SELECT 'missing', 'timestamp', count(*) FILTER (WHERE timestamp IS NULL) FROM after
  UNION ALL SELECT 'missing', 'event_type', count(*) FILTER (WHERE event_type IS NULL) FROM after
  UNION ALL SELECT 'missing', 'value', count(*) FILTER (WHERE value IS NULL OR isnan(value)) FROM after
  UNION ALL SELECT 'duplicates', '', CAST(0 AS BIGINT)
  UNION ALL SELECT 'invalid_rows', '', CAST(0 AS BIGINT)
  UNION ALL SELECT 'valid_rows', '', count(*) FROM after)
SELECT metric, field, CAST(coalesce(before, 0) AS BIGINT) AS before,
       CAST(coalesce(after, 0) AS BIGINT) AS after
FROM b FULL OUTER JOIN a USING (metric, field)""",

    "numeric_summary": _numeric_summary(),

    "date_summary": f"""
WITH {SALES}
SELECT 'Order Date' AS field, count(order_date) AS count, count(*) - count(order_date) AS missing,
       strftime(min(order_date), '%Y-%m-%d') AS min_date,
       strftime(max(order_date), '%Y-%m-%d') AS max_date
FROM sales""",

    "categorical_summary": f"""
WITH {SALES}
SELECT 'Category' AS field, count(category) AS count, count(*) - count(category) AS missing,
       count(DISTINCT category) AS "unique"
FROM sales""",

    "top_values": f"""
WITH {SALES},
c AS (SELECT category AS value, count(*) AS count FROM sales WHERE category IS NOT NULL
      GROUP BY category ORDER BY count DESC, value ASC LIMIT 10)
SELECT 'Category' AS field, value, count FROM c""",

    "missing_by_column": f"""
WITH {DIRTY}
SELECT 'entity_id' AS "column", count(*) FILTER (WHERE entity_id IS NULL) AS missing FROM dirty
UNION ALL SELECT 'timestamp', count(*) FILTER (WHERE timestamp IS NULL) FROM dirty
UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL) FROM dirty
UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL OR isnan(value)) FROM dirty
UNION ALL SELECT 'props', count(*) FILTER (WHERE props IS NULL) FROM dirty""",

    "shape": """
SELECT count(*) AS rows, CAST(7 AS INTEGER) AS columns, CAST(6 AS INTEGER) AS variables
FROM lineitem""",

    "target_stats": f"""
SELECT {RND('min(l_extendedprice)')} AS min, {RND('max(l_extendedprice)')} AS max,
       {RND('avg(l_extendedprice)')} AS mean, count(l_extendedprice) AS count
FROM lineitem""",

    "category_counts": """
SELECT l_returnflag AS value, count(*) AS count FROM lineitem
WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""",

    "grouped_mean": f"""
SELECT l_returnflag AS category, {RND('avg(l_extendedprice)')} AS mean FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_returnflag""",

    "daily_mean": f"""
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day,
       {RND('avg(CAST(l_extendedprice AS DECIMAL(18,2)))')} AS mean
FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL
GROUP BY strftime(l_shipdate, '%Y-%m-%d')""",

    "histogram": f"""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) * 10.0 / (hi - lo)), 9) AS INTEGER) AS bin,
             count(*) AS c
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(generate_series AS INTEGER) AS bin FROM generate_series(0, 9))
SELECT g.bin, {RND('lo + g.bin * ((hi - lo) / 10.0)')} AS lower,
       {RND('CASE WHEN g.bin = 9 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / 10.0) END')} AS upper,
       CAST(coalesce(c, 0) AS BIGINT) AS count
FROM g CROSS JOIN s LEFT JOIN b ON g.bin = b.bin""",

    "box_stats": _box(False),

    "grouped_box_stats": _box(True),

    "thinned_labels": """
WITH d AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem
           WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL),
o AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS position, count(*) OVER () AS n FROM d)
SELECT position, day AS label,
       CASE WHEN n > 12 THEN position % greatest(1, n // 12) = 0 OR position = n - 1
            ELSE true END AS visible
FROM o""",

    "threshold_anomaly": """
SELECT event_id AS entity_id, value, coalesce(value > 100.0, false) AS is_anomaly FROM events""",

    "zscore_anomaly": f"""
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders),
z AS (SELECT o_orderkey, o_orderdate, o_totalprice, abs((o_totalprice - m) / sd) AS z FROM orders, s)
SELECT o_orderkey AS entity_id, {ISO('o_orderdate')} AS timestamp, o_totalprice AS value,
       coalesce(z > 2.0, false) AS is_anomaly, {RND('z')} AS anomaly_score
FROM z""",

    "iqr_anomaly": _iqr_scored() + """
SELECT entity_id, timestamp, anomaly_score, is_anomaly FROM sev""",

    "severity_scored": _iqr_scored() + """
SELECT entity_id, timestamp, anomaly_score, severity, alert FROM sev""",

    "anomaly_summary": _iqr_scored() + f"""
SELECT count(*) AS total_records, count(*) FILTER (WHERE is_anomaly) AS anomaly_count,
       {RND('CAST(count(*) FILTER (WHERE is_anomaly) AS DOUBLE) / count(*)', 6)} AS anomaly_rate
FROM sev""",

    "severity_breakdown": _iqr_scored() + """
SELECT severity, count(*) AS count FROM sev GROUP BY severity""",

    "score_distribution": _iqr_scored() + """
SELECT CAST(anomaly_score AS VARCHAR) AS score, count(*) AS count FROM sev GROUP BY anomaly_score""",

    "linear_trend": f"""
WITH {_trend_fit()}
SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, {ISO('o_orderdate')} AS timestamp,
       {RND('icpt + slope * CAST(x AS DOUBLE)')} AS value
FROM t, fit
UNION ALL
SELECT 'future', 't+' || CAST(k AS VARCHAR), {RND('icpt + slope * CAST(n - 1 + k AS DOUBLE)')}
FROM fit, range(1, 6) r(k)""",

    "moving_average": f"""
WITH RECURSIVE
seed AS (SELECT list_reverse(list(value ORDER BY event_id DESC)[1:2]) AS h
         FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
r(k, h) AS (SELECT 0, h FROM seed
            UNION ALL
            SELECT k + 1, list_append(h, {RND('list_avg(list_slice(h, len(h) - 1, len(h)))')})
            FROM r WHERE k < 5)
SELECT CAST(event_id AS VARCHAR) AS entity_id, {ISO('ts')} AS timestamp,
       CASE WHEN isnan(value) THEN NULL ELSE value END AS value
FROM events
UNION ALL
SELECT 'future', 't+' || CAST(k AS VARCHAR), h[len(h)] FROM r WHERE k > 0""",

    "future_rows": """
SELECT count(*) + 5 AS total, CAST(5 AS BIGINT) AS future FROM events""",

    "regression_metrics": f"""
WITH {_trend_fit()},
p AS (SELECT y, {RND('icpt + slope * CAST(x AS DOUBLE)')} AS pred FROM t, fit)
SELECT {RND('avg(abs(y - pred))')} AS mae, {RND('avg((y - pred) * (y - pred))')} AS mse,
       {RND('sqrt(avg((y - pred) * (y - pred)))')} AS rmse,
       {RND('CASE WHEN var_pop(y) > 0 THEN 1.0 - avg((y - pred) * (y - pred)) / var_pop(y) ELSE 0.0 END')} AS r2,
       count(*) AS support
FROM p""",

    "classification_metrics": _classification(2.0),

    "roc_auc": f"""
WITH {_docs(2.0)},
x AS (SELECT z, label FROM lab WHERE label IS NOT NULL AND z IS NOT NULL),
g AS (SELECT z, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM x GROUP BY z),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM g)
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0
            THEN {RND('sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))')} END AS roc_auc,
       CAST(sum(pos) + sum(neg) AS BIGINT) AS support
FROM c""",

    "model_comparison": " UNION ALL ".join(
        f"SELECT 'anomaly' AS model_type, 'zscore_{t}' AS model, * FROM ({_classification(t)})"
        for t in (1.5, 2.0)),

    "validation_report": f"""
WITH {DIRTY},
c AS (SELECT count(*) AS n,
             count(*) FILTER (WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL) AS v
      FROM dirty)
SELECT CASE WHEN n - v > 0 THEN 'invalid' ELSE 'valid' END AS dataset_status,
       n AS records_processed, v AS valid_records, n - v AS invalid_records FROM c""",

    "box_outliers": """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q),
w AS (SELECT least(coalesce(min(value) FILTER (WHERE value >= lo_f), min(q1)), min(q1)) AS wl,
             greatest(coalesce(max(value) FILTER (WHERE value <= hi_f), min(q3)), min(q3)) AS wh
      FROM events, f)
SELECT event_id, value FROM events, w WHERE value < wl OR value > wh""",

    "detector_summary": """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders)
SELECT count(*) AS total_records,
       count(*) FILTER (WHERE abs((o_totalprice - m) / sd) > 2.0) AS anomaly_count
FROM orders, s""",

    "iqr_fences": f"WITH {SALES_DM} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS field,
       {RND(f'quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))')} AS lower,
       {RND(f'quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))')} AS upper
FROM sales_dm""" for c in ["entity_id", "sales", "quantity", "discount", "profit", "feature_count",
                           "feature_sum"]),

    "profile_filter": f"""
WITH {SALES}
SELECT 'Sales' AS field, count(sales) AS count, count(*) - count(sales) AS missing,
       {RND('avg(sales)')} AS mean FROM sales
UNION ALL
SELECT 'Profit', count(profit), count(*) - count(profit), {RND('avg(profit)')} FROM sales""",

    "anomalous_rows": f"""
SELECT event_id AS entity_id, {ISO('ts')} AS timestamp, value FROM events WHERE value > 100.0""",

    "column_iqr": """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3
           FROM orders)
SELECT o_orderkey, o_totalprice,
       coalesce(o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1), false)
         AS is_anomaly
FROM orders, q""",
}

# one scan or two, the audit is the same
ORACLE["standard_cleaning_audit"] = ORACLE["cleaning_audit"]
