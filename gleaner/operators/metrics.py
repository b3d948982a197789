"""Metric points: keys, counters, gauges, histograms, windows, exports, operations.

Input: a metric table ``(ts, name, metric_type, value, increment, tags)`` and an
operation table ``(op_id, ts, op, duration, memory_delta)``.  "Now" is passed
as ``as_of`` (a literal or a scalar-subquery Column), never read from the
driver clock, so reports are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import discrete_percentile, keep_last, prefix_agg, value_at_rank


def metric_key(name: str | Column = "name", tags: str | Column = "tags") -> Column:
    """``name[k=v,...]`` with tags sorted by key; the bare name without tags."""
    n = F.col(name) if isinstance(name, str) else name
    t = F.col(tags) if isinstance(tags, str) else tags
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(t)),
                                      lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.when(F.coalesce(F.size(t), F.lit(0)) > 0, F.concat(n, F.lit("["), joined, F.lit("]"))).otherwise(n)


def with_key(df: DataFrame) -> DataFrame:
    return df if "metric_key" in df.columns else df.withColumn("metric_key", metric_key())


def since(df: DataFrame, as_of, hours: float = 0, minutes: float = 0, ts: str = "ts") -> DataFrame:
    """Rows not older than ``as_of - span`` (inclusive)."""
    secs = int(hours * 3600 + minutes * 60)
    return df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {secs} SECONDS"))


def counter_totals(df: DataFrame) -> DataFrame:
    """Total of increments per counter key (map-side partial sums)."""
    return (with_key(df).filter(F.col("metric_type") == "counter")
            .groupBy("metric_key").agg(F.sum("increment").alias("total")))


def gauge_latest(df: DataFrame) -> DataFrame:
    """Last value per gauge key, ties on time broken by the later id."""
    return (with_key(df).filter(F.col("metric_type") == "gauge")
            .groupBy("metric_key")
            .agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"),
                 F.max("ts").alias("ts")))


def running_counter(df: DataFrame) -> DataFrame:
    """Cumulative counter value at each increment (two-level running sum)."""
    d = with_key(df).filter(F.col("metric_type") == "counter")
    return prefix_agg(d, ["metric_key"], ["ts", "event_id"], None, {"running_value": ("sum", "increment")})


def histogram_summary(df: DataFrame, n: int = 1000) -> DataFrame:
    """count/min/max/avg/p50/p95/p99 over the newest ``n`` values per key.

    Percentile = sorted[min(floor(p·n), n−1)] (the discrete rule, not an
    interpolated or approximate one).  The newest-n cut bounds every group.
    """
    d = keep_last(with_key(df).filter(F.col("metric_type") == "histogram"), ["metric_key"], n, "ts", "event_id")
    g = d.groupBy("metric_key").agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("avg"), F.array_sort(F.collect_list("value")).alias("_sorted"))
    return g.select(
        "metric_key", "count", "min", "max", "avg",
        *[discrete_percentile(F.col("_sorted"), F.col("count"), p).alias(f"p{int(p * 100)}")
          for p in (0.50, 0.95, 0.99)])


def windowed_metrics(df: DataFrame, width: str = "60 minutes") -> DataFrame:
    """M01 (batch form): per tumbling window and key: count, sum of increments, last value."""
    d = with_key(df)
    return d.groupBy(F.window("ts", width).alias("w"), "metric_key", "metric_type").agg(
        F.count(F.lit(1)).alias("points"), F.sum("increment").alias("increments"),
        F.max_by("value", F.struct("ts", "event_id")).alias("last_value"),
        F.avg("value").alias("avg_value"))


def _mean_duration(ops: DataFrame) -> Column:
    """Mean duration, from whole hundredths (``duration_cents``) where there are any: exact in any order of rows."""
    return F.sum("duration_cents") / F.count(F.lit(1)) / 100.0 if "duration_cents" in ops.columns else F.avg("duration")


def sliding_average(ops: DataFrame, width: str = "5 minutes", slide: str = "1 minute",
                    max_seconds: float = 30.0, max_memory: float | None = None) -> DataFrame:
    """Mean duration per op over sliding windows; flag above the limit."""
    g = ops.groupBy(F.window("ts", width, slide).alias("w"), "op").agg(
        _mean_duration(ops).alias("avg_duration"), F.max("memory_delta").alias("max_memory"),
        F.count(F.lit(1)).alias("n"))
    flag = F.col("avg_duration") > max_seconds
    if max_memory is not None:
        flag = flag | (F.col("max_memory") > max_memory)
    return g.withColumn("breach", flag)


def operation_stats(ops: DataFrame, as_of, hours: float = 1) -> DataFrame:
    """Per operation within the last ``hours``: count and duration/memory stats."""
    return since(ops, as_of, hours=hours).groupBy("op").agg(
        F.count(F.lit(1)).alias("count"),
        _mean_duration(ops).alias("avg_duration"), F.max("duration").alias("max_duration"),
        F.min("duration").alias("min_duration"),
        F.avg("memory_delta").alias("avg_memory_delta"), F.max("memory_delta").alias("max_memory_delta"))


def operation_durations(ops: DataFrame, n: int = 1000) -> DataFrame:
    """Pair start/end rows of one op id into duration and memory delta; newest n per op.

    ``ops`` here is an event log ``(op_id, op, phase in {start,end}, ts, memory)``.
    """
    paired = ops.groupBy("op_id", "op").agg(
        F.min(F.when(F.col("phase") == "start", F.col("ts"))).alias("start_ts"),
        F.max(F.when(F.col("phase") == "end", F.col("ts"))).alias("end_ts"),
        F.min_by("memory", F.when(F.col("phase") == "start", F.col("ts"))).alias("start_mem"),
        F.max_by("memory", F.when(F.col("phase") == "end", F.col("ts"))).alias("end_mem"))
    done = paired.filter(F.col("end_ts").isNotNull() & F.col("start_ts").isNotNull()).select(
        "op_id", "op", "end_ts",
        (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp")))
        .alias("duration_us"),
        (F.col("end_mem") - F.col("start_mem")).alias("memory_delta"))
    return keep_last(done, ["op"], n, "end_ts", "op_id")


def long_running(ops: DataFrame, as_of, limit_seconds: float) -> DataFrame:
    """Operations started and not ended whose age passed the limit."""
    starts = ops.filter(F.col("phase") == "start")
    ends = ops.filter(F.col("phase") == "end").select("op_id")
    open_ops = starts.join(ends, "op_id", "left_anti")
    age = (F.unix_micros(F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of.cast("timestamp"))
           - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return open_ops.withColumn("age_seconds", age).filter(F.col("age_seconds") > limit_seconds)


def performance_summary(ops: DataFrame, limit_seconds: float = 30.0) -> DataFrame:
    """Averages, p95 = sorted[int(.95·n)], limit-exceeded count and rate, time range."""
    agg = ops.agg(F.count(F.lit(1)).alias("operations"), F.avg("duration").alias("avg_duration"),
                  F.avg("memory_delta").alias("avg_memory_delta"),
                  F.count_if(F.col("duration") > limit_seconds).alias("limit_exceeded"),
                  F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    p95 = value_at_rank(ops, "duration", F.least(F.floor(F.lit(0.95) * F.col("_n")), F.col("_n") - 1))
    return agg.join(p95.select(F.col("duration").alias("p95_duration")), how="left").withColumn(
        "limit_exceeded_rate", F.col("limit_exceeded") / F.col("operations"))


def export_json(summary: DataFrame) -> DataFrame:
    """Each summary row as one JSON text line (``to_json(struct(*))``)."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("value"))


def export_history(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append one JSON line per row to the history files under ``path``."""
    df.write.mode(mode).json(path)



def _clean_name(c: Column) -> Column:
    return F.translate(c, ".[=,]", "____")


def export_exposition(counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """``# TYPE n kind`` + ``n value`` lines for counters and gauges (no histograms)."""
    def lines(df, kind, value_col, rank):
        name = _clean_name(F.col("metric_key"))
        return df.select(name.alias("name"), F.lit(rank).alias("kind_rank"),
                         F.concat(F.lit("# TYPE "), name, F.lit(f" {kind}\n"), name, F.lit(" "),
                                  F.col(value_col).cast("string")).alias("text"))
    return lines(counters, "counter", "total", 0).unionByName(lines(gauges, "gauge", "value", 1))
