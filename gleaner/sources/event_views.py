"""Monitoring views derived from the ``events`` table, in both dialects.

Each view exists twice: a Spark builder and a DuckDB CTE body (for the
oracle).  Sums over ``value`` are taken in integer cents so both engines add
exactly and results agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# ---------------------------------------------------------------------------
# metrics: one metric point per event
# ---------------------------------------------------------------------------
_METRIC_TYPE = ("CASE event_type WHEN 'click' THEN 'counter' WHEN 'signup' THEN 'counter' "
                "WHEN 'error' THEN 'gauge' ELSE 'histogram' END")


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.selectExpr(
        "event_id", "ts", "event_type AS name", f"{_METRIC_TYPE} AS metric_type", "value",
        "CAST(round(value * 100) AS BIGINT) AS value_cents",
        "CAST(1 AS BIGINT) AS increment",
        "map('u', CAST(user_id % 5 AS STRING), 'v', CAST(user_id % 2 AS STRING)) AS tags")


METRICS_DUCK = f"""
metrics AS (
  SELECT event_id, ts, event_type AS name, {_METRIC_TYPE} AS metric_type, value,
         CAST(round(value * 100) AS BIGINT) AS value_cents, CAST(1 AS BIGINT) AS increment,
         name || '[u=' || CAST(user_id % 5 AS VARCHAR) || ',v=' || CAST(user_id % 2 AS VARCHAR) || ']' AS metric_key
  FROM events
)"""


# ---------------------------------------------------------------------------
# operations: one timed operation per event
# ---------------------------------------------------------------------------
def operations(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.selectExpr(
        "event_id AS op_id", "ts", "event_type AS op", "value AS duration",
        "CAST(round(value * 100) AS BIGINT) AS duration_cents",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) AS memory_delta",
        "user_id")


OPERATIONS_DUCK = """
operations AS (
  SELECT event_id AS op_id, ts, event_type AS op, value AS duration,
         CAST(round(value * 100) AS BIGINT) AS duration_cents,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory_delta, user_id
  FROM events
)"""


# ---------------------------------------------------------------------------
# health checks: one dependency check per event, rounds by the hour
# ---------------------------------------------------------------------------
_STATUS = ("CASE WHEN event_id % 10 < 8 THEN 'healthy' WHEN event_id % 10 = 8 THEN 'degraded' "
           "ELSE 'unhealthy' END")


def health_checks(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.selectExpr(
        "event_id AS check_id", "ts", "date_trunc('HOUR', ts) AS check_ts", "event_type AS dependency",
        f"{_STATUS} AS status", "value AS duration")


HEALTH_DUCK = f"""
health_checks AS (
  SELECT event_id AS check_id, ts, date_trunc('hour', ts) AS check_ts, event_type AS dependency,
         {_STATUS} AS status, value AS duration
  FROM events
)"""


# ---------------------------------------------------------------------------
# alerts (error events) and their action log
# ---------------------------------------------------------------------------
_SEVERITY = "CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END"


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.filter(F.col("event_type") == "error").selectExpr(
        "event_id AS alert_id", "ts", "concat('a', CAST(user_id % 3 AS STRING)) AS alert_type",
        "concat('m', CAST(user_id % 2 AS STRING)) AS message", f"{_SEVERITY} AS severity")


ALERTS_DUCK = f"""
alerts AS (
  SELECT event_id AS alert_id, ts, 'a' || CAST(user_id % 3 AS VARCHAR) AS alert_type,
         'm' || CAST(user_id % 2 AS VARCHAR) AS message, {_SEVERITY} AS severity
  FROM events WHERE event_type = 'error'
)"""


def alert_actions(spark: SparkSession, sf: str) -> DataFrame:
    al = alerts(spark, sf)
    ack = al.filter(F.col("alert_id") % 2 == 1).select(
        "alert_id", F.lit("acknowledge").alias("action"),
        (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("action_ts"))
    res = al.filter(F.col("alert_id") % 3 == 0).select(
        "alert_id", F.lit("resolve").alias("action"),
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("action_ts"))
    return ack.unionByName(res)


ACTIONS_DUCK = """
alert_actions AS (
  SELECT alert_id, 'acknowledge' AS action, ts + INTERVAL 10 MINUTE AS action_ts FROM alerts WHERE alert_id % 2 = 1
  UNION ALL
  SELECT alert_id, 'resolve' AS action, ts + INTERVAL 30 MINUTE AS action_ts FROM alerts WHERE alert_id % 3 = 0
)"""


# ---------------------------------------------------------------------------
# run log: one clustering run per day
# ---------------------------------------------------------------------------
_RUN_AGG = [
    ("items", "count(*)"),
    ("clusters", "count(DISTINCT user_id) % 9"),
    ("noise", "count_if(event_type = 'error')"),
    ("value_cents", "sum(CAST(round(value * 100) AS BIGINT))"),
    ("max_cents", "max(CAST(round(value * 100) AS BIGINT))"),
    ("views", "count_if(event_type = 'view')"),
    ("purchases", "count_if(event_type = 'purchase')"),
    ("users", "count(DISTINCT user_id)"),
    ("hours", "count(DISTINCT hour(ts))"),
    ("kinds", "count(DISTINCT event_type)"),
    ("run_ts", "min(ts)"),
]

_RUN_DERIVED = [
    "run_day", "run_ts", "CAST(items AS BIGINT) AS items", "CAST(clusters AS BIGINT) AS clusters",
    "CAST(noise AS BIGINT) AS noise",
    "CASE dayofmonth(run_day) % 3 WHEN 0 THEN 'hdbscan' WHEN 1 THEN 'hierarchical' ELSE 'hybrid' END AS algorithm",
    "greatest(-1e0, least(1e0, (value_cents / items / 1e2 - 5e1) / 1e1)) AS silhouette",
    "views / items AS coherence",
    "purchases * 2e0 / items AS source_diversity",
    "noise / items AS noise_ratio",
    "users / items AS cluster_size_diversity",
    "hours / 2.4e1 AS temporal_diversity",
    "CASE WHEN clusters > 0 THEN kinds / 5e0 END AS topic_diversity",
    "value_cents / 1e5 AS processing_time",
    "max_cents / 1.5e4 AS memory_gb",
]

_RUN_SCORED = [
    "*",
    "4e-1 * (silhouette + 1e0) / 2e0 + 3e-1 * coherence + 2e-1 * source_diversity "
    "+ 1e-1 * greatest(0e0, 1e0 - 2e0 * noise_ratio) AS quality_score",
]


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("run_day", F.to_date("ts"))
    agg = ev.groupBy("run_day").agg(*[F.expr(e).alias(n) for n, e in _RUN_AGG])
    runs = agg.selectExpr(*_RUN_DERIVED).selectExpr(*_RUN_SCORED)
    return runs.withColumn(
        "fallback_used", (F.col("algorithm") == "hybrid") & (F.col("silhouette") < 0.3)
    ).withColumn(
        "is_valid", (F.col("quality_score") >= 0.3) & (F.col("noise_ratio") <= 0.3) & (F.col("clusters") > 0))


RUNLOG_DUCK = ("""
run_agg AS (
  SELECT CAST(ts AS DATE) AS run_day, """ + ", ".join(f"{e} AS {n}" for n, e in _RUN_AGG) + """
  FROM events GROUP BY 1
),
run_base AS (SELECT """ + ", ".join(_RUN_DERIVED) + """ FROM run_agg),
run_log AS (
  SELECT *, """ + _RUN_SCORED[1] + """,
         algorithm = 'hybrid' AND silhouette < 0.3 AS fallback_used
  FROM run_base
),
run_log_v AS (
  SELECT *, quality_score >= 0.3 AND noise_ratio <= 0.3 AND clusters > 0 AS is_valid FROM run_log
)""")


def as_of(df: DataFrame, col: str = "ts"):
    """The newest timestamp of ``df`` as a scalar subquery (the "now" of a report)."""
    return df.select(F.max(col)).scalar()
