"""Structured Streaming forms of the monitoring jobs.

Event tables are read with ``readStream``; ``ts`` (zone-less in the landed
table) is cast to TIMESTAMP in the session time zone (UTC), because a
watermark needs TIMESTAMP.  Stateful operators keep one small state row per
key (alert type, operation) in the state store and see each micro-batch's
rows of a key sorted by time, so the answer equals the batch job's when the
input arrives in time order; rows behind the watermark are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.alerts import walk_alerts
from ..session import measured, scratch_path, written


#: Rows of one landed file.
FILE_ROWS = 1_000_000


def land_in_order(df: DataFrame, steps: int = 4, ts: str = "ts", file_rows: int = FILE_ROWS) -> tuple[str, object, int]:
    """Copy a table into ``steps`` time ranges of parquet files (a replayable stream source):
    (path, schema, files of each range).

    The file source replays files by modification time, so the ranges are written one
    after another, each by as many tasks as it takes at ``file_rows`` rows a file; a
    trigger that reads so many files reads one range.  Range bounds come from approximate
    quantiles (a few scalars on the driver).  Rows without a time come first."""
    spark = df.sparkSession
    path = scratch_path(spark, "stream-src")
    num = F.unix_micros(F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts)
    d, seen = measured(df.withColumn("_k", num.cast("double")), "stream-rows")
    width = max(1, math.ceil(seen["rows"] / steps / file_rows))
    qs = sorted(set(d.approxQuantile("_k", [i / steps for i in range(1, steps)], 0.0001))) if steps > 1 and seen["rows"] else []
    bounds = [None] + qs + [None]
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        cond = F.lit(True) if lo is None else F.col("_k") > lo
        cond = cond if hi is None else cond & (F.col("_k") <= hi)
        part = d.filter(F.coalesce(cond, F.lit(i == 0))).drop("_k")
        part.repartition(width).sortWithinPartitions(ts).write.mode("append").parquet(path)
    return path, df.schema, width


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, ts: str = "ts") -> DataFrame:
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))
    return s.withColumn(ts, F.col(ts).cast("timestamp"))


def run_available_now(stream: DataFrame, name: str, mode: str = "append",
                      foreach_batch: Callable | None = None) -> str:
    """Drain everything available into a parquet sink; returns the sink path."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"sink-{name}")
    ckpt = scratch_path(spark, f"ckpt-{name}")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(lambda b, i: foreach_batch(b, i, out)).start()
    else:
        q = w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out


# ---------------------------------------------------------------------------
# M01 windowed metrics
# ---------------------------------------------------------------------------
def windowed_metrics_stream(metrics: DataFrame, width: str = "60 minutes", delay: str = "0 minutes") -> DataFrame:
    """Per tumbling window and key: points, increments, last value, mean (append mode:
    a window is written once the watermark passes its end)."""
    return (metrics.withWatermark("ts", delay)
            .groupBy(F.window("ts", width).alias("w"), "metric_key", "metric_type")
            .agg(F.count(F.lit(1)).alias("points"), F.sum("increment").alias("increments"),
                 F.max_by("value", F.struct("ts", "event_id")).alias("last_value"),
                 F.sum("value_cents").alias("cents")))


# ---------------------------------------------------------------------------
# M04 cooldown / M05 cooldown + duplicates, stateful
# ---------------------------------------------------------------------------
ALERT_OUT = "alert_id long, alert_type string, ts timestamp"


def _cooldown_fn(cooldown_us: int, dedup: bool):
    def fn(key, batches, state):
        last, open_ = (None, {}) if not state.exists else (state.get[0], dict(state.get[1] or {}))
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf["us"] = pdf["ts"].astype("datetime64[us]").astype("int64")
        pdf = pdf.sort_values(["us", "kind", "alert_id"], kind="mergesort")
        sent, last, open_ = walk_alerts(pdf, last, open_, cooldown_us, dedup)
        state.update((last, open_))
        out = pdf[(pdf["kind"] == 1) & pdf["alert_id"].isin(sent)]
        if len(out):
            yield out[["alert_id", "alert_type", "ts"]]
    return fn


def alert_cooldown_stream(events: DataFrame, minutes: int = 15, dedup: bool = False) -> DataFrame:
    """M04 (dedup=False) and M05 (dedup=True) as a true stream over ``alert_events``
    (alerts and, for M05, the resolutions of the action log): state per alert type is
    (last sent time, open messages); a resolution takes its message out of the state."""
    fn = _cooldown_fn(minutes * 60 * 1_000_000, dedup)
    return events.groupBy("alert_type").applyInPandasWithState(
        fn, ALERT_OUT, "last_us long, open map<string,long>", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------------------
# M26 sustained breach, stateful
# ---------------------------------------------------------------------------
BREACH_OUT = "op_id long, op string, breach_seconds double, sustained boolean"


def sustained_breach_stream(ops: DataFrame, limit: float, span_seconds: int) -> DataFrame:
    """Per operation: how long the limit has been broken, from the run's first breaching reading."""
    def fn(key, batches, state):
        start = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "op_id"], kind="mergesort")
        rows = []
        for oid, ts, dur in zip(pdf["op_id"], pdf["ts"], pdf["duration"]):
            us = int(pd.Timestamp(ts).value // 1000)
            if dur > limit:
                start = us if start is None else start
                secs = (us - start) / 1e6
                rows.append((int(oid), key[0], secs, secs >= span_seconds))
            else:
                start = None
                rows.append((int(oid), key[0], 0.0, False))
        state.update((start,))
        if rows:
            yield pd.DataFrame(rows, columns=["op_id", "op", "breach_seconds", "sustained"])
    return ops.groupBy("op").applyInPandasWithState(
        fn, BREACH_OUT, "start long", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------------------
# S09 incremental append, F02 delivery
# ---------------------------------------------------------------------------
def append_batches(batch: DataFrame, batch_id: int, path: str) -> None:
    """S09 sink: every micro-batch is appended as soon as it is ready, tagged by batch."""
    batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").partitionBy("batch_id").parquet(path)


def fill_second_pass(spark: SparkSession, path: str, labels: DataFrame, key: str) -> DataFrame:
    """S09 second pass: labels computed later are joined to the appended rows, and only the
    batches that have rows with a label are rewritten, in place.

    The new rows are staged first, since they are read from the folder that they replace;
    files of other batches stay as they are.  Rows without a key keep null labels."""
    rows = spark.read.parquet(path)
    touched = rows.select("batch_id", key).join(labels.select(key), key, "left_semi").select("batch_id").distinct()
    staged = written(rows.join(F.broadcast(touched), "batch_id", "left_semi").join(labels, key, "left"), "filled")  # a row for each batch
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    return spark.read.schema(staged.schema).parquet(path)


def deliver_by_type(batch: DataFrame, batch_id: int, path: str) -> None:
    """F02 handler: write each micro-batch of sent alerts to one folder per alert type
    (stands in for a mail/chat/webhook side effect)."""
    batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").partitionBy("alert_type").json(path)

