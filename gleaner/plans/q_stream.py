"""Streaming queries: each lands its input as time-ordered files, drains it with an
``availableNow`` stream and returns the sink read back.  The oracles are the batch
oracles of the same operators, so stream = batch is checked directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as AL
from ..sources import event_views as V
from ..sources.fixtures import ITEMS_DUCK, items, with_ctes
from ..sources.tables import table
from ..streaming import streams as SS
from .q_cluster import CLUSTERS_DUCK, clusters
from .q_monitor import TSD, TSF, resolutions
from .registry import ORACLES, register


def _alerts_stream(spark, sf, resolved=None):
    return SS.read_stream(spark, *SS.land_in_order(AL.alert_events(V.alerts(spark, sf), resolved), 4))


@register("m01_windowed_metrics_stream", with_ctes(V.METRICS_DUCK) + f"""
SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '{TSD}') AS window_start, metric_key, metric_type,
       count(*) AS points, CAST(sum(increment) AS BIGINT) AS increments,
       arg_max(value, (ts, event_id)) AS last_value, round(sum(value_cents) / count(*) / 100.0, 6) AS avg_value
FROM metrics WHERE time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events)
GROUP BY time_bucket(INTERVAL 60 MINUTE, ts), metric_key, metric_type""")
def m01_windowed_metrics_stream(spark, sf):
    ev = table(spark, sf, "events")
    s = SS.read_stream(spark, *SS.land_in_order(ev, 4))
    m = s.selectExpr("event_id", "ts", "event_type AS name", f"{V._METRIC_TYPE} AS metric_type", "value",
                     "CAST(round(value * 100) AS BIGINT) AS value_cents", "CAST(1 AS BIGINT) AS increment",
                     "concat(event_type, '[u=', CAST(user_id % 5 AS STRING), ',v=', CAST(user_id % 2 AS STRING), ']') AS metric_key")
    out = SS.run_available_now(SS.windowed_metrics_stream(m), "m01")
    r = spark.read.parquet(out)
    return r.select(F.date_format("w.start", TSF).alias("window_start"), "metric_key", "metric_type", "points",
                    "increments", "last_value", F.round(F.col("cents") / F.col("points") / 100.0, 6).alias("avg_value"))


@register("m04_alert_cooldown_stream")
def m04_alert_cooldown_stream(spark, sf):
    out = SS.run_available_now(SS.alert_cooldown_stream(_alerts_stream(spark, sf), 15), "m04")
    return spark.read.parquet(out).select("alert_id", "alert_type")


@register("m05_alert_dedup_stream")
def m05_alert_dedup_stream(spark, sf):
    out = SS.run_available_now(SS.alert_cooldown_stream(_alerts_stream(spark, sf, resolutions(spark, sf)), 15, dedup=True), "m05")
    return spark.read.parquet(out).select("alert_id", "alert_type")


@register("m26_sustained_breach_stream")
def m26_sustained_breach_stream(spark, sf):
    ops = V.operations(spark, sf)
    s = SS.read_stream(spark, *SS.land_in_order(ops, 4))
    out = SS.run_available_now(SS.sustained_breach_stream(s, 100.0, 1800), "m26")
    r = spark.read.parquet(out)
    return r.select("op_id", F.round("breach_seconds", 6).alias("breach_seconds"), "sustained")


@register("f02_deliver_alerts")
def f02_deliver_alerts(spark, sf):
    sent = SS.alert_cooldown_stream(_alerts_stream(spark, sf), 15)
    out = SS.run_available_now(sent, "f02", foreach_batch=SS.deliver_by_type)
    return spark.read.json(out).select(F.col("alert_id").cast("long"), "alert_type")


@register("s09_incremental_append", with_ctes(ITEMS_DUCK, CLUSTERS_DUCK) + """
SELECT i.item_id, i.headline, c.cluster_id FROM items i LEFT JOIN clusters c ON c.id = i.item_id""")
def s09_incremental_append(spark, sf):
    it = items(spark, sf).select("item_id", "headline", "ord")
    path, schema, width = SS.land_in_order(it, 4, "ord")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", width).parquet(path)
    out = SS.run_available_now(s, "s09", foreach_batch=SS.append_batches)
    labels = clusters(spark, sf).select(F.col("id").alias("item_id"), "cluster_id")
    return SS.fill_second_pass(spark, out, labels, "item_id").select("item_id", "headline", "cluster_id")


def _share_oracles() -> None:
    """Streams must equal the batch jobs: reuse the batch oracles."""
    for s_name, b_name in [("m04_alert_cooldown_stream", "m04_alert_cooldown"),
                           ("m05_alert_dedup_stream", "m05_alert_dedup"),
                           ("m26_sustained_breach_stream", "m26_sustained_breach"),
                           ("f02_deliver_alerts", "m04_alert_cooldown")]:
        if b_name in ORACLES:
            ORACLES[s_name] = ORACLES[b_name]


_share_oracles()
