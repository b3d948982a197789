"""Queries for metrics, health, alerts and run quality (all over ``events``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as AL
from ..operators import health as H
from ..operators import metrics as M
from ..operators import runs as R
from ..operators.series import keep_last
from ..session import scratch_path
from ..sources import event_views as V
from ..sources.fixtures import with_ctes
from .registry import register

TSF = "yyyy-MM-dd HH:mm:ss"          # Spark
TSD = "%Y-%m-%d %H:%M:%S"            # DuckDB
AS_OF_D = "(SELECT max(ts) FROM events)"


def _ts(c):
    return F.date_format(c, TSF)


def _r6(c):
    return F.round(c, 6)


def as_of(spark, sf):
    from ..sources.tables import table
    return table(spark, sf, "events").select(F.max("ts")).scalar()


# ----------------------------------------------------------------------------
# metrics
# ----------------------------------------------------------------------------
@register("t24_metric_key", with_ctes(V.METRICS_DUCK) + "SELECT event_id, metric_key FROM metrics")
def t24_metric_key(spark, sf):
    return V.metrics(spark, sf).select("event_id", M.metric_key().alias("metric_key"))


@register("a18_counter_totals", with_ctes(V.METRICS_DUCK) +
          "SELECT metric_key, CAST(sum(increment) AS BIGINT) AS total FROM metrics "
          "WHERE metric_type = 'counter' GROUP BY 1")
def a18_counter_totals(spark, sf):
    return M.counter_totals(V.metrics(spark, sf))


@register("a19_gauge_latest", with_ctes(V.METRICS_DUCK) +
          "SELECT metric_key, arg_max(value, (ts, event_id)) AS value, strftime(max(ts), '" + TSD + "') AS ts "
          "FROM metrics WHERE metric_type = 'gauge' GROUP BY 1")
def a19_gauge_latest(spark, sf):
    g = M.gauge_latest(V.metrics(spark, sf))
    return g.select("metric_key", "value", _ts("ts").alias("ts"))


@register("w08_running_counter", with_ctes(V.METRICS_DUCK) +
          "SELECT event_id, metric_key, CAST(sum(increment) OVER (PARTITION BY metric_key ORDER BY ts, event_id "
          "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_value FROM metrics WHERE metric_type = 'counter'")
def w08_running_counter(spark, sf):
    return M.running_counter(V.metrics(spark, sf)).select("event_id", "metric_key",
                                                          F.col("running_value").cast("long").alias("running_value"))


@register("a17_histogram_summary", with_ctes(V.METRICS_DUCK, """
last_n AS (
  SELECT * FROM metrics WHERE metric_type = 'histogram'
  QUALIFY row_number() OVER (PARTITION BY metric_key ORDER BY ts DESC, event_id DESC) <= 1000
)""", """
g AS (
  SELECT metric_key, count(*) AS n, min(value) AS mn, max(value) AS mx, sum(value_cents) AS cents,
         list_sort(list(value)) AS s FROM last_n GROUP BY 1
)""") + """
SELECT metric_key, n AS count, mn AS min, mx AS max, round(cents / n / 100.0, 6) AS avg,
       s[CAST(least(floor(CAST(0.5 AS DOUBLE) * n), n - 1) AS BIGINT) + 1] AS p50,
       s[CAST(least(floor(CAST(0.95 AS DOUBLE) * n), n - 1) AS BIGINT) + 1] AS p95,
       s[CAST(least(floor(CAST(0.99 AS DOUBLE) * n), n - 1) AS BIGINT) + 1] AS p99
FROM g""")
def a17_histogram_summary(spark, sf):
    h = M.histogram_summary(V.metrics(spark, sf))
    return h.withColumn("avg", _r6("avg"))


@register("w03_keep_last", with_ctes(V.METRICS_DUCK) + """
SELECT event_id, metric_key FROM metrics
QUALIFY row_number() OVER (PARTITION BY metric_key ORDER BY ts DESC, event_id DESC) <= 100""")
def w03_keep_last(spark, sf):
    d = M.with_key(V.metrics(spark, sf))
    return keep_last(d, ["metric_key"], 100, "ts", "event_id").select("event_id", "metric_key")


@register("g13_since", with_ctes(V.METRICS_DUCK) +
          f"SELECT event_id FROM metrics WHERE ts >= {AS_OF_D} - INTERVAL 24 HOUR")
def g13_since(spark, sf):
    return M.since(V.metrics(spark, sf), as_of(spark, sf), hours=24).select("event_id")


@register("m01_windowed_metrics", with_ctes(V.METRICS_DUCK) + f"""
SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '{TSD}') AS window_start, metric_key, metric_type,
       count(*) AS points, CAST(sum(increment) AS BIGINT) AS increments,
       arg_max(value, (ts, event_id)) AS last_value, round(sum(value_cents) / count(*) / 100.0, 6) AS avg_value
FROM metrics GROUP BY ALL""")
def m01_windowed_metrics(spark, sf):
    w = M.windowed_metrics(V.metrics(spark, sf), "60 minutes")
    return w.select(_ts("w.start").alias("window_start"), "metric_key", "metric_type", "points", "increments",
                    "last_value", _r6("avg_value").alias("avg_value"))


@register("m02_sliding_average", with_ctes(V.OPERATIONS_DUCK, f"""
win AS (
  SELECT time_bucket(INTERVAL 1 MINUTE, ts) - (k * INTERVAL 1 MINUTE) AS w, op, duration_cents, memory_delta
  FROM operations, range(0, 5) t(k)
)""") + f"""
SELECT strftime(w, '{TSD}') AS window_start, op, round(sum(duration_cents) / count(*) / 100.0, 6) AS avg_duration,
       count(*) AS n, (sum(duration_cents) / count(*) / 100.0 > 30 OR max(memory_delta) > 80) AS breach
FROM win GROUP BY ALL""")
def m02_sliding_average(spark, sf):
    ops = V.operations(spark, sf)
    g = M.sliding_average(ops, "5 minutes", "1 minute", 30.0, 80)
    return g.select(_ts("w.start").alias("window_start"), "op", _r6("avg_duration").alias("avg_duration"), "n", "breach")


@register("a20_operation_stats", with_ctes(V.OPERATIONS_DUCK) + f"""
SELECT op, count(*) AS count, round(sum(duration_cents) / count(*) / 100.0, 6) AS avg_duration,
       max(duration) AS max_duration, min(duration) AS min_duration,
       round(avg(memory_delta), 6) AS avg_memory_delta, max(memory_delta) AS max_memory_delta
FROM operations WHERE ts >= {AS_OF_D} - INTERVAL 6 HOUR GROUP BY 1""")
def a20_operation_stats(spark, sf):
    s = M.operation_stats(V.operations(spark, sf), as_of(spark, sf), hours=6)
    return s.withColumns({c: _r6(c) for c in ("avg_duration", "avg_memory_delta")})


@register("a24_performance_summary", with_ctes(V.OPERATIONS_DUCK, """
srt AS (SELECT duration, row_number() OVER (ORDER BY duration) - 1 AS rk, count(*) OVER () AS n FROM operations)""") + f"""
SELECT (SELECT count(*) FROM operations) AS operations,
       (SELECT round(sum(duration_cents) / count(*) / 100.0, 6) FROM operations) AS avg_duration,
       (SELECT CAST(count_if(duration > 30) AS BIGINT) FROM operations) AS limit_exceeded,
       (SELECT round(count_if(duration > 30) / count(*), 6) FROM operations) AS limit_exceeded_rate,
       (SELECT strftime(min(ts), '{TSD}') FROM operations) AS first_ts,
       (SELECT strftime(max(ts), '{TSD}') FROM operations) AS last_ts,
       (SELECT duration FROM srt WHERE rk = least(CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT), n - 1)) AS p95_duration""")
def a24_performance_summary(spark, sf):
    ops = V.operations(spark, sf)
    s = M.performance_summary(ops, 30.0)
    avg = ops.agg(_r6(F.sum("duration_cents") / F.count(F.lit(1)) / 100.0).alias("avg_duration"))
    return s.drop("avg_duration", "avg_memory_delta").crossJoin(avg).select(
        "operations", "avg_duration", "limit_exceeded", _r6("limit_exceeded_rate").alias("limit_exceeded_rate"),
        _ts("first_ts").alias("first_ts"), _ts("last_ts").alias("last_ts"), "p95_duration")


@register("s10_export_metrics_json", with_ctes(V.METRICS_DUCK) +
          "SELECT CAST(to_json({'metric_key': metric_key, 'total': CAST(sum(increment) AS BIGINT)}) AS VARCHAR) AS value "
          "FROM metrics WHERE metric_type = 'counter' GROUP BY metric_key")
def s10_export_metrics_json(spark, sf):
    return M.export_json(M.counter_totals(V.metrics(spark, sf)))


@register("s11_export_exposition", with_ctes(V.METRICS_DUCK, """
named AS (SELECT *, translate(metric_key, '.[=,]', '____') AS nm FROM metrics)""") + """
SELECT nm AS name, '# TYPE ' || nm || ' counter' || chr(10) || nm || ' ' || CAST(sum(increment) AS VARCHAR) AS text
FROM named WHERE metric_type = 'counter' GROUP BY nm
UNION ALL
SELECT nm AS name, '# TYPE ' || nm || ' gauge' || chr(10) || nm || ' ' || CAST(arg_max(value, (ts, event_id)) AS VARCHAR) AS text
FROM named WHERE metric_type = 'gauge' GROUP BY nm""")
def s11_export_exposition(spark, sf):
    m = V.metrics(spark, sf)
    return M.export_exposition(M.counter_totals(m), M.gauge_latest(m)).select("name", "text")


@register("s12_export_history", with_ctes(V.RUNLOG_DUCK) + """
SELECT CAST(to_json({'run_day': CAST(run_day AS VARCHAR), 'algorithm': algorithm, 'items': items,
                     'clusters': clusters, 'noise': noise}) AS VARCHAR) AS value
FROM run_log_v""")
def s12_export_history(spark, sf):
    runs = V.run_log(spark, sf)
    rows = runs.select(F.col("run_day").cast("string").alias("run_day"), "algorithm", "items", "clusters", "noise")
    path = scratch_path(spark, "history")
    M.export_history(rows, path)
    return spark.read.text(path)


# ----------------------------------------------------------------------------
# health
# ----------------------------------------------------------------------------
_ROUNDS_D = """
rounds AS (
  SELECT check_ts, count(*) AS dependencies,
         CASE WHEN bool_or(status IN ('unhealthy', 'error')) THEN 'unhealthy'
              WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'healthy' END AS status
  FROM health_checks GROUP BY 1
)"""


def _rounds(spark, sf):
    return H.overall_health(V.health_checks(spark, sf))


@register("m09_overall_health", with_ctes(V.HEALTH_DUCK, _ROUNDS_D) +
          f"SELECT strftime(check_ts, '{TSD}') AS check_ts, dependencies, status FROM rounds")
def m09_overall_health(spark, sf):
    return _rounds(spark, sf).select(_ts("check_ts").alias("check_ts"), "dependencies", "status")


@register("w06_status_changes", with_ctes(V.HEALTH_DUCK, _ROUNDS_D, """
lagged AS (SELECT *, lag(status) OVER (ORDER BY check_ts) AS previous FROM rounds)""") + f"""
SELECT strftime(check_ts, '{TSD}') AS check_ts, status, previous,
  CASE WHEN status = 'unhealthy' THEN 'service_unhealthy'
       WHEN status = 'degraded' AND coalesce(previous, 'healthy') = 'healthy' THEN 'service_degraded'
       WHEN status = 'healthy' AND coalesce(previous, 'healthy') <> 'healthy' THEN 'service_recovered' END AS change
FROM lagged WHERE previous IS NULL OR previous <> status""")
def w06_status_changes(spark, sf):
    return H.status_changes(_rounds(spark, sf)).select(_ts("check_ts").alias("check_ts"), "status", "previous", "change")


@register("w07_consecutive_failures", with_ctes(V.HEALTH_DUCK, """
p1 AS (SELECT check_id, dependency, status, ts, row_number() OVER (PARTITION BY dependency ORDER BY ts, check_id) AS p
       FROM health_checks)""", """
p2 AS (SELECT *, max(CASE WHEN status = 'healthy' THEN p ELSE 0 END) OVER (PARTITION BY dependency ORDER BY ts, check_id
       ROWS UNBOUNDED PRECEDING) AS last_ok FROM p1)""") + """
SELECT check_id, CAST(CASE WHEN status <> 'healthy' THEN p - last_ok ELSE 0 END AS BIGINT) AS consecutive_failures FROM p2""")
def w07_consecutive_failures(spark, sf):
    c = H.consecutive_failures(V.health_checks(spark, sf))
    return c.select("check_id", F.col("consecutive_failures").cast("long").alias("consecutive_failures"))


@register("a22_uptime", with_ctes(V.HEALTH_DUCK, _ROUNDS_D) + f"""
SELECT count(*) AS total_checks, CAST(count_if(status = 'healthy') AS BIGINT) AS healthy_checks,
       round(coalesce(count_if(status = 'healthy') * 100.0 / nullif(count(*), 0), 100.0), 6) AS uptime_percentage
FROM rounds WHERE check_ts >= {AS_OF_D} - INTERVAL 24 HOUR""")
def a22_uptime(spark, sf):
    u = H.uptime(_rounds(spark, sf), as_of(spark, sf), hours=24)
    return u.select("total_checks", "healthy_checks", _r6("uptime_percentage").alias("uptime_percentage"))


@register("k06_recent_issues", with_ctes(V.HEALTH_DUCK, _ROUNDS_D, f"""
last AS (SELECT * FROM rounds WHERE check_ts >= {AS_OF_D} - INTERVAL 24 HOUR AND status <> 'healthy'
         ORDER BY check_ts DESC LIMIT 10)""") + f"""
SELECT strftime(l.check_ts, '{TSD}') AS check_ts, l.status,
       (SELECT array_to_string(list_sort(list(DISTINCT h.dependency)), ',') FROM health_checks h
        WHERE h.check_ts = l.check_ts AND h.status <> 'healthy') AS dependencies
FROM last l""")
def k06_recent_issues(spark, sf):
    r = H.recent_issues(_rounds(spark, sf), V.health_checks(spark, sf), as_of(spark, sf))
    return r.select(_ts("check_ts").alias("check_ts"), "status", "dependencies")


@register("m11_readiness", with_ctes(V.HEALTH_DUCK, _ROUNDS_D, """
dep AS (SELECT dependency, arg_max(status, (ts, check_id)) AS status FROM health_checks GROUP BY 1)""", """
crit AS (SELECT coalesce(bool_and(status = 'healthy'), TRUE) AS critical_ok FROM dep WHERE dependency IN ('view', 'click'))""",
          """cur AS (SELECT arg_max(status, check_ts) AS current_status FROM rounds)""") + """
SELECT critical_ok, current_status, critical_ok AND current_status IN ('healthy', 'degraded') AS ready FROM crit, cur""")
def m11_readiness(spark, sf):
    return H.readiness(V.health_checks(spark, sf), _rounds(spark, sf), ["view", "click"]).select(
        "critical_ok", "current_status", "ready")


@register("m24_health_summary", with_ctes(V.HEALTH_DUCK, _ROUNDS_D, f"""
up AS (SELECT round(coalesce(count_if(status = 'healthy') * 100.0 / nullif(count(*), 0), 100.0), 6) AS uptime_percentage,
       count(*) AS total_checks FROM rounds WHERE check_ts >= {AS_OF_D} - INTERVAL 24 HOUR)""", f"""
iss AS (SELECT count(*) AS recent_issues FROM (SELECT * FROM rounds WHERE check_ts >= {AS_OF_D} - INTERVAL 24 HOUR
        AND status <> 'healthy' ORDER BY check_ts DESC LIMIT 10))""", """
dep AS (SELECT array_to_string(list_sort(list(dependency || '=' || s)), ',') AS dependency_status
        FROM (SELECT dependency, arg_max(status, (ts, check_id)) AS s FROM health_checks GROUP BY 1))""") + f"""
SELECT (SELECT arg_max(status, check_ts) FROM rounds) AS current_status,
       (SELECT strftime(max(check_ts), '{TSD}') FROM rounds) AS last_check,
       uptime_percentage, total_checks, recent_issues, dependency_status FROM up, iss, dep""")
def m24_health_summary(spark, sf):
    s = H.health_summary(V.health_checks(spark, sf), _rounds(spark, sf), as_of(spark, sf))
    return s.select("current_status", _ts("last_check").alias("last_check"),
                    _r6("uptime_percentage").alias("uptime_percentage"), "total_checks", "recent_issues",
                    "dependency_status")


_READINGS_SPARK = ("event_id", "ts",
                   "CASE event_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'disk' ELSE 'cpu' END AS resource",
                   "(CAST(round(value * 100) AS BIGINT) % 10000) / 1e2 AS percent")
_READINGS_D = """
readings AS (
  SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'disk' ELSE 'cpu' END AS resource,
         (CAST(round(value * 100) AS BIGINT) % 10000) / 1e2 AS percent FROM events
)"""


@register("m10_resource_status", with_ctes(_READINGS_D) + """
SELECT event_id, resource, CASE
  WHEN percent > CASE resource WHEN 'memory' THEN 90 ELSE 95 END THEN 'unhealthy'
  WHEN percent > CASE resource WHEN 'memory' THEN 80 ELSE 85 END THEN 'degraded' ELSE 'healthy' END AS status
FROM readings""")
def m10_resource_status(spark, sf):
    from ..sources.tables import table
    rd = table(spark, sf, "events").selectExpr(*_READINGS_SPARK)
    return H.resource_status(rd).select("event_id", "resource", "status")


_PRESSURE_SPARK_AGG = dict(
    memory_gb="max(CASE WHEN resource = 'memory' THEN percent END) / 4e1",
    disk_percent="max(CASE WHEN resource = 'disk' THEN percent END)",
    cpu_percent="max(CASE WHEN resource = 'cpu' THEN percent END)")


@register("m23_pressure_report", with_ctes(_READINGS_D, """
hourly AS (
  SELECT date_trunc('hour', ts) AS h, max(CASE WHEN resource = 'memory' THEN percent END) / 4e1 AS memory_gb,
         max(CASE WHEN resource = 'disk' THEN percent END) AS disk_percent,
         max(CASE WHEN resource = 'cpu' THEN percent END) AS cpu_percent
  FROM readings GROUP BY 1
)""") + f"""
SELECT strftime(h, '{TSD}') AS hour,
  CAST(coalesce((memory_gb > 2.0)::INT, 0) + coalesce((disk_percent > 90)::INT, 0) AS BIGINT) AS n_issues,
  CAST(coalesce((memory_gb <= 2.0 AND memory_gb > 1.6)::INT, 0) + coalesce((cpu_percent > 90)::INT, 0)
       + coalesce((disk_percent <= 90 AND disk_percent > 80)::INT, 0) AS BIGINT) AS n_warnings,
  NOT coalesce(memory_gb > 2.0, FALSE) AND NOT coalesce(disk_percent > 90, FALSE) AS healthy
FROM hourly""")
def m23_pressure_report(spark, sf):
    from ..sources.tables import table
    rd = table(spark, sf, "events").selectExpr(*_READINGS_SPARK)
    hourly = rd.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(
        *[F.expr(e).alias(n) for n, e in _PRESSURE_SPARK_AGG.items()])
    p = H.pressure_report(hourly, 2.0)
    return p.select(_ts("h").alias("hour"), F.size("issues").cast("long").alias("n_issues"),
                    F.size("warnings").cast("long").alias("n_warnings"), "healthy")


@register("m26_sustained_breach", with_ctes(V.OPERATIONS_DUCK, """
o AS (SELECT *, duration > 100 AS breach, epoch_us(ts) AS us FROM operations)""", """
o1 AS (SELECT *, breach AND NOT coalesce(lag(breach) OVER (PARTITION BY op ORDER BY ts, op_id), FALSE) AS starts FROM o)""", """
o2 AS (SELECT *, max(CASE WHEN starts THEN us END) OVER (PARTITION BY op ORDER BY ts, op_id ROWS UNBOUNDED PRECEDING) AS start FROM o1)""") + """
SELECT op_id, round(CASE WHEN breach THEN (us - start) / 1e6 ELSE 0.0 END, 6) AS breach_seconds,
       breach AND (us - start) / 1e6 >= 1800 AS sustained
FROM o2""")
def m26_sustained_breach(spark, sf):
    ops = V.operations(spark, sf)
    s = H.sustained_breach(ops, ["op"], F.col("duration") > 100, 1800, order=("ts", "op_id"))
    return s.select("op_id", _r6("breach_seconds").alias("breach_seconds"), "sustained")


# ----------------------------------------------------------------------------
# alerts
# ----------------------------------------------------------------------------
@register("a21_alert_statistics", with_ctes(V.ALERTS_DUCK, f"""
r AS (SELECT * FROM alerts WHERE ts >= {AS_OF_D} - INTERVAL 72 HOUR)""") + """
SELECT 'total' AS dimension, 'all' AS key, count(*) AS alerts FROM r
UNION ALL SELECT 'severity', severity, count(*) FROM r GROUP BY severity
UNION ALL SELECT 'type', alert_type, count(*) FROM r GROUP BY alert_type""")
def a21_alert_statistics(spark, sf):
    return AL.alert_statistics(V.alerts(spark, sf), as_of(spark, sf), hours=72)


@register("k05_top_alert_types", with_ctes(V.ALERTS_DUCK) +
          "SELECT alert_type, count(*) AS alerts FROM alerts GROUP BY 1 ORDER BY 2 DESC, min(ts) LIMIT 10")
def k05_top_alert_types(spark, sf):
    return AL.top_alert_types(V.alerts(spark, sf), 10)


_LIFE_D = """
life AS (
  SELECT a.*, (SELECT min(action_ts) FROM alert_actions x WHERE x.alert_id = a.alert_id AND action = 'acknowledge') AS acknowledged_at,
         (SELECT min(action_ts) FROM alert_actions x WHERE x.alert_id = a.alert_id AND action = 'resolve') AS resolved_at
  FROM alerts a
),
life2 AS (
  SELECT *, CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN acknowledged_at IS NOT NULL THEN 'acknowledged'
                 ELSE 'open' END AS state FROM life
)"""


def _life(spark, sf):
    return AL.alert_lifecycle(V.alerts(spark, sf), V.alert_actions(spark, sf))


@register("m06_alert_lifecycle", with_ctes(V.ALERTS_DUCK, V.ACTIONS_DUCK, _LIFE_D) + "SELECT alert_id, state FROM life2")
def m06_alert_lifecycle(spark, sf):
    return _life(spark, sf).select("alert_id", "state")


@register("m07_purge_resolved", with_ctes(V.ALERTS_DUCK, V.ACTIONS_DUCK, _LIFE_D) +
          f"SELECT alert_id FROM life2 WHERE state <> 'resolved' OR ts >= {AS_OF_D} - INTERVAL 24 HOUR")
def m07_purge_resolved(spark, sf):
    return AL.purge_resolved(_life(spark, sf), as_of(spark, sf), 24).select("alert_id")


@register("m29_incident_report", with_ctes(V.ALERTS_DUCK, V.ACTIONS_DUCK, _LIFE_D) + """
SELECT alert_type, count(*) AS incidents,
       round(avg((epoch_us(acknowledged_at) - epoch_us(ts)) / 6e7), 6) AS mean_minutes_to_detect,
       round(avg((epoch_us(resolved_at) - epoch_us(ts)) / 6e7), 6) AS mean_minutes_to_recover,
       round(count_if(resolved_at IS NOT NULL AND acknowledged_at IS NULL) / count(*), 6) AS false_positive_share
FROM life2 GROUP BY 1""")
def m29_incident_report(spark, sf):
    r = AL.incident_report(_life(spark, sf))
    return r.select("alert_type", "incidents", *[_r6(c).alias(c) for c in
                    ("mean_minutes_to_detect", "mean_minutes_to_recover", "false_positive_share")])


_MSG = ("CASE alert_id % 4 WHEN 0 THEN 'Memory usage exceeded limit' WHEN 1 THEN 'Silhouette score low' "
        "WHEN 2 THEN 'Service became unhealthy' ELSE 'Queue size high' END")
_SRC = "CASE alert_id % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'quality' ELSE 'health' END"


@register("m08_severity", with_ctes(V.ALERTS_DUCK) + f"""
SELECT alert_id, CASE src
  WHEN 'performance' THEN CASE WHEN contains(lower(msg), 'exceeded') THEN 'critical' ELSE 'warning' END
  WHEN 'quality' THEN CASE WHEN contains(lower(msg), 'low') THEN 'warning' ELSE 'info' END
  WHEN 'health' THEN CASE WHEN contains(lower(msg), 'unhealthy') THEN 'critical' ELSE 'warning' END
  ELSE 'info' END AS severity
FROM (SELECT alert_id, {_SRC} AS src, {_MSG} AS msg FROM alerts)""")
def m08_severity(spark, sf):
    a = V.alerts(spark, sf)
    return a.select("alert_id", AL.severity(F.expr(_SRC), F.expr(_MSG)).alias("severity"))


@register("m04_alert_cooldown", with_ctes(V.ALERTS_DUCK, """
nxt AS (
  SELECT a.alert_id, (SELECT b.alert_id FROM alerts b WHERE b.alert_type = a.alert_type
                      AND b.ts >= a.ts + INTERVAL 15 MINUTE ORDER BY b.ts, b.alert_id LIMIT 1) AS next_id
  FROM alerts a
)""").replace("WITH ", "WITH RECURSIVE ", 1).replace("nxt AS (", "nxt AS (", 1) + """
, chain(alert_id) AS (
  SELECT arg_min(alert_id, (ts, alert_id)) FROM alerts GROUP BY alert_type
  UNION ALL
  SELECT n.next_id FROM chain c JOIN nxt n ON n.alert_id = c.alert_id WHERE n.next_id IS NOT NULL
)
SELECT alert_id, alert_type FROM alerts WHERE alert_id IN (SELECT alert_id FROM chain)""")
def m04_alert_cooldown(spark, sf):
    return AL.alert_cooldown(V.alerts(spark, sf), 15).select("alert_id", "alert_type")


def resolutions(spark, sf):
    return V.alert_actions(spark, sf).filter(F.col("action") == "resolve")


@register("m05_alert_dedup", with_ctes(V.ALERTS_DUCK, V.ACTIONS_DUCK, """
ends AS (
  SELECT alert_id, alert_type, ts, message, coalesce(r.done, TIMESTAMP '9999-01-01') AS done
  FROM alerts LEFT JOIN (SELECT alert_id, min(action_ts) AS done FROM alert_actions WHERE action = 'resolve' GROUP BY 1) r
       USING (alert_id)
)""").replace("WITH ", "WITH RECURSIVE ", 1) + """
, st(alert_type, alert_id, ts, sent) AS (
  SELECT alert_type, arg_min(alert_id, (ts, alert_id)), min(ts),
         [{'m': arg_min(message, (ts, alert_id)), 'done': arg_min(done, (ts, alert_id))}]
  FROM ends GROUP BY alert_type
  UNION ALL
  SELECT s.alert_type, n.alert_id, n.ts,
         list_append(list_filter(s.sent, lambda x: x.done > n.ts), {'m': n.message, 'done': n.done})
  FROM st s JOIN ends n ON n.alert_type = s.alert_type AND n.ts >= s.ts + INTERVAL 15 MINUTE
       AND len(list_filter(s.sent, lambda x: x.m = n.message AND x.done > n.ts)) = 0
  QUALIFY row_number() OVER (PARTITION BY s.alert_type ORDER BY n.ts, n.alert_id) = 1
)
SELECT alert_id, alert_type FROM st""")
def m05_alert_dedup(spark, sf):
    return AL.alert_dedup(V.alerts(spark, sf), 15, resolutions(spark, sf)).select("alert_id", "alert_type")


# ----------------------------------------------------------------------------
# run quality
# ----------------------------------------------------------------------------
_RUN = with_ctes(V.RUNLOG_DUCK)


def _runs(spark, sf):
    return V.run_log(spark, sf)


_QLOG_D = """
qlog AS (
  SELECT run_ts, run_day, metric, value FROM (
    SELECT run_ts, run_day, unnest([
      {'metric': 'silhouette', 'value': silhouette}, {'metric': 'coherence', 'value': coherence},
      {'metric': 'source_diversity', 'value': source_diversity}, {'metric': 'noise_ratio', 'value': noise_ratio},
      {'metric': 'quality_score', 'value': quality_score},
      {'metric': 'is_valid', 'value': CAST(CAST(is_valid AS INTEGER) AS DOUBLE)}], max_depth := 2)
    FROM run_log_v) WHERE value IS NOT NULL
)"""


@register("m13_quality_log", with_ctes(V.RUNLOG_DUCK, _QLOG_D) +
          "SELECT CAST(run_day AS VARCHAR) AS run_day, metric, round(value, 6) AS value FROM qlog")
def m13_quality_log(spark, sf):
    r = _runs(spark, sf)
    q = R.quality_log(r.withColumn("run_ts", F.col("run_day")))
    return q.select(F.col("run_ts").cast("string").alias("run_day"), "metric", _r6("value").alias("value"))


@register("a23_recent_averages", _RUN + """
SELECT round(avg(silhouette), 6) AS avg_silhouette, round(avg(coherence), 6) AS avg_coherence,
       round(avg(quality_score), 6) AS avg_quality_score, round(avg(noise_ratio), 6) AS avg_noise_ratio
FROM (SELECT * FROM run_log_v ORDER BY run_ts DESC LIMIT 10)""")
def a23_recent_averages(spark, sf):
    a = R.recent_averages(_runs(spark, sf), 10)
    return a.select(*[_r6(c).alias(c) for c in a.columns])


@register("m14_quality_summary", _RUN + """
SELECT round(arg_max(quality_score, run_ts), 6) AS current_quality_score, round(arg_max(silhouette, run_ts), 6) AS current_silhouette,
       strftime(max(run_ts), '%Y-%m-%d %H:%M:%S') AS last_run, count(*) AS history_count,
       (SELECT round(avg(quality_score), 6) FROM (SELECT * FROM run_log_v ORDER BY run_ts DESC LIMIT 10)) AS avg_quality_score,
       0.2 AS min_silhouette, 0.3 AS max_noise_ratio
FROM run_log_v""")
def m14_quality_summary(spark, sf):
    s = R.quality_summary(_runs(spark, sf))
    return s.select(_r6("current_quality_score").alias("current_quality_score"),
                    _r6("current_silhouette").alias("current_silhouette"), _ts("last_run").alias("last_run"),
                    "history_count", _r6("avg_quality_score").alias("avg_quality_score"),
                    "min_silhouette", "max_noise_ratio")


@register("w05_trend_stats", with_ctes(V.RUNLOG_DUCK, _QLOG_D, """
ix AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run_ts) - 1 AS i,
              count(*) OVER (PARTITION BY metric) AS n FROM qlog)""", """
g AS (SELECT metric, arg_max(value, run_ts) AS current, avg(value) AS average, count(*) AS points,
             stddev_pop(value) AS sd, avg(CASE WHEN i < n // 2 THEN value END) AS fm,
             avg(CASE WHEN i >= n // 2 THEN value END) AS sm FROM ix GROUP BY 1)""") + """
SELECT metric, round(current, 6) AS current, round(average, 6) AS average, points,
  CASE WHEN points < 2 THEN 'stable'
       WHEN (CASE WHEN fm <> 0 THEN (sm - fm) / fm * 100.0 ELSE 0 END) > 5 THEN 'improving'
       WHEN (CASE WHEN fm <> 0 THEN (sm - fm) / fm * 100.0 ELSE 0 END) < -5 THEN 'declining' ELSE 'stable' END AS trend,
  round(CASE WHEN points > 1 THEN sd ELSE 0 END, 6) AS volatility
FROM g""")
def w05_trend_stats(spark, sf):
    r = _runs(spark, sf)
    t = R.trend_stats(R.quality_log(r))
    return t.select("metric", _r6("current").alias("current"), _r6("average").alias("average"), "points", "trend",
                    _r6("volatility").alias("volatility"))


@register("w04_trend", with_ctes(V.RUNLOG_DUCK, """
ix AS (SELECT quality_score AS value, row_number() OVER (ORDER BY run_ts) - 1 AS i, count(*) OVER () AS n FROM run_log_v)""",
          """g AS (SELECT count(*) AS n, avg(CASE WHEN i < n // 2 THEN value END) AS fm, avg(CASE WHEN i >= n // 2 THEN value END) AS sm FROM ix)""") + """
SELECT CASE WHEN n < 2 THEN 'stable'
  WHEN (CASE WHEN fm <> 0 THEN (sm - fm) / fm * 100.0 ELSE 0 END) > 5 THEN 'improving'
  WHEN (CASE WHEN fm <> 0 THEN (sm - fm) / fm * 100.0 ELSE 0 END) < -5 THEN 'declining' ELSE 'stable' END AS trend FROM g""")
def w04_trend(spark, sf):
    r = _runs(spark, sf)
    t = R.trend_stats(R.quality_log(r, ["quality_score"]))
    return t.select("trend")


_SLA_ROWS_D = """
sla_rows AS (
  SELECT run_ts AS ts, 'processing_time' AS metric, processing_time AS value FROM run_log_v
  UNION ALL SELECT run_ts, 'memory_gb', memory_gb FROM run_log_v
  UNION ALL SELECT run_ts, 'silhouette', silhouette FROM run_log_v
  UNION ALL SELECT run_ts, 'noise_ratio', noise_ratio FROM run_log_v
  UNION ALL SELECT run_ts, 'success_percent', CASE WHEN clusters > 0 THEN 100.0 ELSE 0.0 END FROM run_log_v
  UNION ALL SELECT (SELECT max(run_ts) FROM run_log_v), 'uptime_percent', coalesce(count_if(status = 'healthy') * 100.0 / nullif(count(*), 0), 100.0)
    FROM rounds WHERE check_ts >= (SELECT max(run_ts) FROM run_log_v) - INTERVAL 720 HOUR
),
slas AS (SELECT * FROM (VALUES
  ('availability', 'uptime_percent', 99.5, 720, 'min'), ('processing_time_p95', 'processing_time', 30.0, 24, 'max_p95'),
  ('memory_usage', 'memory_gb', 2.0, 24, 'max'), ('silhouette_score', 'silhouette', 0.2, 168, 'min_avg'),
  ('noise_ratio', 'noise_ratio', 0.3, 168, 'max_avg'), ('success_rate', 'success_percent', 95.0, 24, 'min_avg'),
  ('cache_efficiency', 'cache_percent', 70.0, 24, 'min_avg')) t(sla, metric, target, window_hours, kind))"""


def _sla_rows(r):
    cols = [("processing_time", F.col("processing_time")), ("memory_gb", F.col("memory_gb")),
            ("silhouette", F.col("silhouette")), ("noise_ratio", F.col("noise_ratio")),
            ("success_percent", F.when(F.col("clusters") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))]
    out = None
    for m, c in cols:
        d = r.select(F.col("run_ts").alias("ts"), F.lit(m).alias("metric"), c.cast("double").alias("value"))
        out = d if out is None else out.unionByName(d)
    return out


@register("m15_sla_report", with_ctes(V.RUNLOG_DUCK, V.HEALTH_DUCK, _ROUNDS_D, _SLA_ROWS_D, """
o AS (SELECT sla, list_sort(list(value)) AS v, CASE kind WHEN 'max' THEN max(value) WHEN 'min' THEN min(value) WHEN 'max_p95' THEN NULL ELSE avg(value) END AS x
  FROM sla_rows JOIN slas USING (metric)
  WHERE value IS NOT NULL AND ts >= (SELECT max(run_ts) FROM run_log_v) - window_hours * INTERVAL 1 HOUR GROUP BY sla, kind)""", """
obs AS (SELECT s.*, coalesce(len(v), 0) AS points,
  CASE WHEN kind = 'max_p95' THEN v[least(CAST(floor(0.95 * len(v)) AS BIGINT), len(v) - 1) + 1] ELSE x END AS observed
  FROM slas s LEFT JOIN o USING (sla))""") + """
SELECT sla, CAST(target AS DOUBLE) AS target, round(observed, 6) AS observed,
  coalesce(CASE WHEN starts_with(kind, 'min') THEN observed >= target ELSE observed <= target END, FALSE) AS met, points FROM obs""")
def m15_sla_report(spark, sf):
    r = _runs(spark, sf)
    slas = spark.createDataFrame(R.SLAS, "sla string, metric string, target double, window_hours int, kind string")
    now = r.select(F.max("run_ts")).scalar()
    up = H.uptime(_rounds(spark, sf), now, hours=720).select(
        now.alias("ts"), F.lit("uptime_percent").alias("metric"), F.col("uptime_percentage").cast("double").alias("value"))
    rep = R.sla_report(_sla_rows(r).unionByName(up), slas, now)
    return rep.select("sla", "target", _r6("observed").alias("observed"), "met", "points")


_BANDS_D = """
bands AS (SELECT * FROM (VALUES ('processing_time_p50', 15.0, 25.0, 30.0, FALSE), ('memory_gb', 0.5, 1.5, 2.0, FALSE),
  ('silhouette', 0.3, 0.5, 0.7, TRUE), ('noise_ratio', 0.2, 0.25, 0.3, FALSE), ('coherence', 0.4, 0.6, 0.8, TRUE),
  ('cache_hit_rate', 0.7, 0.8, 0.9, TRUE), ('items_per_minute', 10.0, 20.0, 40.0, TRUE),
  ('cpu_percent', 50.0, 80.0, 95.0, FALSE), ('disk_percent', 70.0, 85.0, 95.0, FALSE))
  t(metric, base, mid, top, higher_is_better))"""


@register("m16_baseline_band", with_ctes(V.RUNLOG_DUCK, _QLOG_D, _BANDS_D) + """
SELECT CAST(run_day AS VARCHAR) AS run_day, metric, CASE
  WHEN higher_is_better AND value >= top THEN 'excellent' WHEN higher_is_better AND value >= mid THEN 'good'
  WHEN higher_is_better AND value >= base THEN 'baseline' WHEN higher_is_better THEN 'below_baseline'
  WHEN value >= top THEN 'critical' WHEN value >= mid THEN 'warning' WHEN value > base THEN 'above_baseline'
  ELSE 'normal' END AS band
FROM qlog JOIN bands USING (metric)""")
def m16_baseline_band(spark, sf):
    r = _runs(spark, sf)
    q = R.quality_log(r.withColumn("run_ts", F.col("run_day")))
    b = R.baseline_band(q, R.baseline_table(spark))
    return b.select(F.col("run_ts").cast("string").alias("run_day"), "metric", "band")


@register("m17_baseline_delta", with_ctes(V.RUNLOG_DUCK, _QLOG_D, _BANDS_D) + """
SELECT CAST(run_day AS VARCHAR) AS run_day, metric, round(value - base, 6) AS delta FROM qlog JOIN bands USING (metric)""")
def m17_baseline_delta(spark, sf):
    r = _runs(spark, sf)
    q = R.quality_log(r.withColumn("run_ts", F.col("run_day")))
    d = R.baseline_delta(q, R.baseline_table(spark))
    return d.select(F.col("run_ts").cast("string").alias("run_day"), "metric", _r6("delta").alias("delta"))


_ISSUES_D = """
iss AS (
  SELECT *, list_filter([
    CASE WHEN silhouette < 0.2 THEN 'silhouette' END, CASE WHEN noise_ratio > 0.3 THEN 'noise' END,
    CASE WHEN coherence < 0.4 THEN 'coherence' END, CASE WHEN source_diversity < 0.2 THEN 'diversity' END],
    lambda x: x IS NOT NULL) AS kinds
  FROM run_log_v
)"""


@register("a28_issue_counts", with_ctes(V.RUNLOG_DUCK, _ISSUES_D) +
          "SELECT k AS issue_type, count(*) AS issues, count(*) FILTER (k <> 'noise') AS recommendations "
          "FROM (SELECT unnest(kinds) AS k FROM iss) GROUP BY 1")
def a28_issue_counts(spark, sf):
    return R.issue_counts(_runs(spark, sf))


@register("t25_issue_type", with_ctes(V.RUNLOG_DUCK, _ISSUES_D) +
          "SELECT CAST(run_day AS VARCHAR) AS run_day, unnest(kinds) AS issue_type FROM iss")
def t25_issue_type(spark, sf):
    d = R.run_issues(_runs(spark, sf)).select(F.col("run_day").cast("string").alias("run_day"),
                                              F.explode("issues").alias("issue"))
    return d.select("run_day", R.issue_type(F.col("issue")).alias("issue_type"))


@register("m18_run_quality_alerts", with_ctes(V.RUNLOG_DUCK, _ISSUES_D) + """
SELECT CAST(run_day AS VARCHAR) AS run_day, 'low_quality_score' AS alert, CAST(len(kinds) AS BIGINT) AS n_issues
FROM iss WHERE quality_score < 0.2
UNION ALL
SELECT CAST(run_day AS VARCHAR), 'many_issues', CAST(len(kinds) AS BIGINT) FROM iss WHERE len(kinds) > 3""")
def m18_run_quality_alerts(spark, sf):
    r = _runs(spark, sf)
    a = R.run_quality_alerts(r.withColumn("run_ts", F.col("run_day")))
    n = R.run_issues(r).select(F.col("run_day").alias("run_ts"), F.size("issues").cast("long").alias("n_issues"))
    return a.join(n, "run_ts").select(F.col("run_ts").cast("string").alias("run_day"), "alert", "n_issues")


@register("m19_validation_failed", with_ctes(V.RUNLOG_DUCK, _ISSUES_D) + """
SELECT CAST(run_day AS VARCHAR) AS run_day, 'Clustering validation failed with ' || CAST(len(kinds) AS VARCHAR) || ' issues' AS message,
       round(quality_score, 6) AS quality_score
FROM iss WHERE NOT is_valid""")
def m19_validation_failed(spark, sf):
    r = _runs(spark, sf)
    v = R.validation_failed(r.withColumn("run_ts", F.col("run_day")))
    return v.select(F.col("run_ts").cast("string").alias("run_day"), "message", _r6("quality_score").alias("quality_score"))


@register("m20_run_metrics", _RUN + """
SELECT CAST(run_day AS VARCHAR) AS run_day, algorithm, name, metric_type, round(value, 6) AS value FROM (
  SELECT run_day, algorithm, unnest([
    {'name': 'clustering.processing.duration', 'metric_type': 'histogram', 'value': processing_time},
    {'name': 'clustering.processing.count', 'metric_type': 'counter', 'value': 1.0},
    {'name': 'clustering.quality.silhouette_score', 'metric_type': 'gauge', 'value': silhouette},
    {'name': 'clustering.quality.coherence', 'metric_type': 'gauge', 'value': coherence},
    {'name': 'clustering.quality.overall_score', 'metric_type': 'gauge', 'value': quality_score},
    {'name': 'clustering.clusters.count', 'metric_type': 'gauge', 'value': CAST(clusters AS DOUBLE)},
    {'name': 'clustering.items.total', 'metric_type': 'gauge', 'value': CAST(items AS DOUBLE)},
    {'name': 'clustering.items.noise', 'metric_type': 'gauge', 'value': CAST(noise AS DOUBLE)},
    {'name': 'clustering.quality.noise_ratio', 'metric_type': 'gauge', 'value': CASE WHEN items > 0 THEN noise / items END}
  ], max_depth := 2) FROM run_log_v) WHERE value IS NOT NULL""")
def m20_run_metrics(spark, sf):
    r = _runs(spark, sf)
    m = R.run_metrics(r.withColumn("run_ts", F.col("run_day")))
    return m.select(F.col("run_ts").cast("string").alias("run_day"), "algorithm", "name", "metric_type",
                    _r6("value").alias("value"))


@register("m28_quality_level", _RUN + """
SELECT CAST(run_day AS VARCHAR) AS run_day, CASE
  WHEN quality_score >= 0.8 AND quality_score < 1.0 THEN 'Excellent' WHEN quality_score >= 0.6 AND quality_score < 0.8 THEN 'Good'
  WHEN quality_score >= 0.4 AND quality_score < 0.6 THEN 'Fair' WHEN quality_score >= 0.2 AND quality_score < 0.4 THEN 'Poor'
  WHEN quality_score >= 0.0 AND quality_score < 0.2 THEN 'Very Poor' ELSE 'Unknown' END AS level FROM run_log_v""")
def m28_quality_level(spark, sf):
    r = _runs(spark, sf)
    return r.select(F.col("run_day").cast("string").alias("run_day"), R.quality_level(F.col("quality_score")).alias("level"))


@register("a27_business_metrics", _RUN + """
SELECT CAST(run_day AS VARCHAR) AS run_day, clusters > 0 AS success, round(items / processing_time, 6) AS items_per_second,
       round(CASE WHEN clusters <> 0 THEN items / clusters END, 6) AS mean_cluster_size,
       round(1.0 - noise / items, 6) AS data_quality FROM run_log_v""")
def a27_business_metrics(spark, sf):
    r = _runs(spark, sf)
    b = R.business_metrics(r.withColumn("run_ts", F.col("run_day")))
    return b.select(F.col("run_ts").cast("string").alias("run_day"), "success",
                    *[_r6(c).alias(c) for c in ("items_per_second", "mean_cluster_size", "data_quality")])


@register("a25_throughput", _RUN + """
SELECT CAST(sum(items) AS BIGINT) AS items, round(sum(value_cents) / 1e5, 6) AS seconds,
       round(sum(items) / (sum(value_cents) / 1e5), 6) AS items_per_second,
       round(sum(items) / (sum(value_cents) / 1e5) * 60.0, 6) AS items_per_minute
FROM run_log_v JOIN (SELECT run_day, value_cents FROM run_agg) USING (run_day)""")
def a25_throughput(spark, sf):
    from ..sources.tables import table
    ev = table(spark, sf, "events")
    # processing time summed in exact cents, as in the oracle
    runs = ev.groupBy(F.to_date("ts").alias("run_day")).agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    t = R.throughput(runs.select("items", (F.col("cents") / 1e5).alias("processing_time")))
    tot = runs.agg(F.sum("cents").alias("c"))
    return t.crossJoin(tot).select(
        F.col("items").cast("long").alias("items"), _r6(F.col("c") / 1e5).alias("seconds"),
        _r6(F.col("items") / (F.col("c") / 1e5)).alias("items_per_second"),
        _r6(F.col("items") / (F.col("c") / 1e5) * 60.0).alias("items_per_minute"))


@register("a29_fallback_rate", _RUN + """
SELECT algorithm, count(*) AS runs, round(count_if(fallback_used) / count(*), 6) AS fallback_share,
       round(avg(processing_time), 6) AS mean_seconds FROM run_log_v GROUP BY 1""")
def a29_fallback_rate(spark, sf):
    f = R.fallback_rate(_runs(spark, sf))
    return f.select("algorithm", "runs", _r6("fallback_share").alias("fallback_share"), _r6("mean_seconds").alias("mean_seconds"))


@register("m27_diversity_alerts", _RUN + """
SELECT CAST(run_day AS VARCHAR) AS run_day, g.gauge, round(g.value, 6) AS value,
       g.gauge = 'quality.diversity.source' AND g.value < 0.2 AS alert
FROM (SELECT run_day, unnest([{'gauge': 'quality.diversity.source', 'value': source_diversity},
                              {'gauge': 'quality.diversity.cluster_size', 'value': cluster_size_diversity},
                              {'gauge': 'quality.diversity.temporal', 'value': temporal_diversity},
                              {'gauge': 'quality.diversity.topic', 'value': topic_diversity}]) AS g FROM run_log_v)
WHERE g.value IS NOT NULL""")
def m27_diversity_alerts(spark, sf):
    r = _runs(spark, sf)
    d = R.diversity_alerts(r.withColumn("run_ts", F.col("run_day")))
    return d.select(F.col("run_ts").cast("string").alias("run_day"), "gauge", _r6("value").alias("value"), "alert")


@register("m12_service_status", with_ctes(V.RUNLOG_DUCK, V.HEALTH_DUCK, _ROUNDS_D) + """
SELECT h.health_ok, round(r.memory_gb, 6) AS memory_gb, round(r.quality_score, 6) AS quality_score,
       h.health_ok AND r.memory_gb < 2.0 AND r.quality_score > 0.3 AS service_ok
FROM (SELECT arg_max(status, check_ts) = 'healthy' AS health_ok FROM rounds) h,
     (SELECT arg_max(memory_gb, run_ts) AS memory_gb, arg_max(quality_score, run_ts) AS quality_score FROM run_log_v) r""")
def m12_service_status(spark, sf):
    h = _rounds(spark, sf).agg((F.max_by("status", "check_ts") == "healthy").alias("health_ok"))
    r = _runs(spark, sf)
    mem = r.agg(F.max_by("memory_gb", "run_ts").alias("memory_gb"))
    q = r.agg(F.max_by("quality_score", "run_ts").alias("quality_score"))
    s = R.service_status(h, mem, q)
    return s.select("health_ok", _r6("memory_gb").alias("memory_gb"), _r6("quality_score").alias("quality_score"),
                    "service_ok")


@register("m25_status_report", with_ctes(V.RUNLOG_DUCK, V.HEALTH_DUCK, _ROUNDS_D, V.ALERTS_DUCK, V.ACTIONS_DUCK, _LIFE_D) + """
SELECT (SELECT arg_max(status, check_ts) FROM rounds) AS health_status,
       (SELECT round(avg(processing_time), 6) FROM run_log_v) AS avg_processing_time,
       (SELECT round(arg_max(quality_score, run_ts), 6) FROM run_log_v) AS latest_quality_score,
       (SELECT count(*) FROM life2 WHERE state <> 'resolved') AS active_alerts""")
def m25_status_report(spark, sf):
    h = _rounds(spark, sf).agg(F.max_by("status", "check_ts").alias("health_status"))
    r = _runs(spark, sf).agg(_r6(F.avg("processing_time")).alias("avg_processing_time"),
                             _r6(F.max_by("quality_score", "run_ts")).alias("latest_quality_score"))
    a = _life(spark, sf).filter(F.col("state") != "resolved").agg(F.count(F.lit(1)).alias("active_alerts"))
    return h.crossJoin(r).crossJoin(a)


@register("m03_threshold_alerts", with_ctes(V.RUNLOG_DUCK, """
vals AS (
  SELECT run_day, unnest([{'metric': 'silhouette', 'value': silhouette}, {'metric': 'noise_ratio', 'value': noise_ratio},
    {'metric': 'coherence', 'value': coherence}, {'metric': 'quality_score', 'value': quality_score},
    {'metric': 'processing_time', 'value': processing_time}, {'metric': 'memory_gb', 'value': memory_gb}], max_depth := 2)
  FROM run_log_v
)""", """
rules AS (SELECT * FROM (VALUES ('silhouette', '<', 0.2, 'silhouette_score_low', 'warning'),
  ('noise_ratio', '>', 0.3, 'noise_ratio_high', 'warning'), ('coherence', '<', 0.4, 'coherence_low', 'warning'),
  ('quality_score', '<', 0.3, 'quality_score_low', 'warning'),
  ('processing_time', '>', 30.0, 'processing_time_exceeded', 'critical'),
  ('memory_gb', '>', 2.0, 'memory_limit_exceeded', 'critical')) t(metric, comparator, lim, alert_type, severity))""") + """
SELECT CAST(run_day AS VARCHAR) AS run_day, alert_type, severity FROM vals JOIN rules USING (metric)
WHERE (comparator = '>' AND value > lim) OR (comparator = '<' AND value < lim)""")
def m03_threshold_alerts(spark, sf):
    r = _runs(spark, sf)
    vals = R.quality_log(r.withColumn("run_ts", F.col("run_day")),
                         ["silhouette", "noise_ratio", "coherence", "quality_score", "processing_time", "memory_gb"])
    rules = spark.createDataFrame(THRESHOLD_RULES, "metric string, comparator string, limit double, "
                                                   "alert_type string, severity string")
    a = AL.threshold_alerts(vals, rules)
    return a.select(F.col("run_ts").cast("string").alias("run_day"), "alert_type", "severity")


# FIXED VALUES — threshold rules (metric, comparator, limit, alert type, severity)
THRESHOLD_RULES = [
    ("silhouette", "<", 0.2, "silhouette_score_low", "warning"),
    ("noise_ratio", ">", 0.3, "noise_ratio_high", "warning"),
    ("coherence", "<", 0.4, "coherence_low", "warning"),
    ("quality_score", "<", 0.3, "quality_score_low", "warning"),
    ("processing_time", ">", 30.0, "processing_time_exceeded", "critical"),
    ("memory_gb", ">", 2.0, "memory_limit_exceeded", "critical"),
]


@register("a26_hit_rate", """
SELECT CAST(count_if(CAST(json_extract_string(props, '$.k') AS INTEGER) >= 20) AS BIGINT) AS hits,
       count(*) AS lookups,
       round(coalesce(count_if(CAST(json_extract_string(props, '$.k') AS INTEGER) >= 20) / nullif(count(*), 0), 0), 6) AS hit_rate
FROM events WHERE event_type = 'view'""")
def a26_hit_rate(spark, sf):
    from ..sources.tables import table
    lk = table(spark, sf, "events").filter(F.col("event_type") == "view").select(
        (F.get_json_object("props", "$.k").cast("int") >= 20).alias("hit"))
    return lk.agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("lookups"),
                  _r6(F.coalesce(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), F.lit(0.0))).alias("hit_rate"))


# ----------------------------------------------------------------------------
# operation event log: a start row per operation and an end row once it has ended
# (ops whose end lies after the report time are still running)
# ----------------------------------------------------------------------------
def _op_log(spark, sf):
    ops = V.operations(spark, sf)
    now = as_of(spark, sf)
    start = ops.select("op_id", "op", F.lit("start").alias("phase"), "ts",
                       (F.col("user_id") + 100.0).alias("memory"))
    end_ts = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("duration"))
    end = ops.filter(end_ts <= now).select("op_id", "op", F.lit("end").alias("phase"), end_ts.alias("ts"),
                                           (F.col("user_id") + 100.0 + F.col("memory_delta")).alias("memory"))
    return start.unionByName(end)


_OPLOG_D = f"""
op_log AS (
  SELECT op_id, op, 'start' AS phase, ts, user_id + 100.0 AS memory FROM operations
  UNION ALL
  SELECT op_id, op, 'end', ts + to_microseconds(CAST(round(duration * 1e6) AS BIGINT)), user_id + 100.0 + memory_delta
  FROM operations WHERE ts + to_microseconds(CAST(round(duration * 1e6) AS BIGINT)) <= {AS_OF_D}
)"""


@register("m22_operation_durations", with_ctes(V.OPERATIONS_DUCK, _OPLOG_D) + """
SELECT op_id, op, duration_us, round(memory_delta, 6) AS memory_delta FROM (
  SELECT s.op_id, s.op, epoch_us(e.ts) - epoch_us(s.ts) AS duration_us, e.memory - s.memory AS memory_delta, e.ts AS end_ts
  FROM op_log s JOIN op_log e ON s.op_id = e.op_id AND s.phase = 'start' AND e.phase = 'end')
QUALIFY row_number() OVER (PARTITION BY op ORDER BY end_ts DESC, op_id DESC) <= 1000""")
def m22_operation_durations(spark, sf):
    d = M.operation_durations(_op_log(spark, sf), 1000)
    return d.select("op_id", "op", "duration_us", F.round("memory_delta", 6).alias("memory_delta"))


@register("m21_long_running", with_ctes(V.OPERATIONS_DUCK, _OPLOG_D) + f"""
SELECT op_id, op, round((epoch_us({AS_OF_D}) - epoch_us(ts)) / 1e6, 6) AS age_seconds FROM op_log s
WHERE phase = 'start' AND op_id NOT IN (SELECT op_id FROM op_log WHERE phase = 'end')
  AND (epoch_us({AS_OF_D}) - epoch_us(ts)) / 1e6 > 10""")
def m21_long_running(spark, sf):
    r = M.long_running(_op_log(spark, sf), as_of(spark, sf), 10.0)
    return r.select("op_id", "op", F.round("age_seconds", 6).alias("age_seconds"))
