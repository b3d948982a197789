"""Health checks: overall status per round, changes, failure runs, uptime, readiness, resources.

Input: ``health_checks(check_id, ts, check_ts, dependency, status)``; one
check round groups the dependency checks with the same ``check_ts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import since
from .series import islands, prefix_agg, row_pieces


def overall_health(checks: DataFrame) -> DataFrame:
    """Per round: unhealthy if any dependency is unhealthy/error, degraded if any degraded."""
    return checks.groupBy("check_ts").agg(
        F.bool_or(F.col("status").isin("unhealthy", "error")).alias("_bad"),
        F.bool_or(F.col("status") == "degraded").alias("_deg"),
        F.count(F.lit(1)).alias("dependencies"),
    ).select("check_ts", "dependencies",
             F.when(F.col("_bad"), "unhealthy").when(F.col("_deg"), "degraded").otherwise("healthy").alias("status"))


def status_changes(rounds: DataFrame) -> DataFrame:
    """Rounds whose status differs from the previous round, with the alert type.

    The previous round is found inside each day; a day's first round takes the
    last status of the days before from a table with one row per day.
    """
    d = rounds.withColumn("_day", F.date_trunc("day", "check_ts"))
    last = d.groupBy("_day").agg(F.max_by("status", "check_ts").alias("_last"))
    last = last.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_before"))
    d = d.join(last, "_day").withColumn("previous", F.coalesce(
        F.lag("status").over(Window.partitionBy("_day").orderBy("check_ts")), F.col("_before"))).drop("_day", "_before")
    d = d.filter(F.col("previous").isNull() | (F.col("previous") != F.col("status")))
    return d.withColumn(
        "change",
        F.when(F.col("status") == "unhealthy", "service_unhealthy")
         .when((F.col("status") == "degraded") & (F.coalesce(F.col("previous"), F.lit("healthy")) == "healthy"),
               "service_degraded")
         .when((F.col("status") == "healthy") & (F.coalesce(F.col("previous"), F.lit("healthy")) != "healthy"),
               "service_recovered"))


def consecutive_failures(checks: DataFrame) -> DataFrame:
    """Per dependency, length of the current run of non-healthy checks (0 when healthy)."""
    return islands(checks, ["dependency"], ["ts", "check_id"], F.col("status") != "healthy").withColumnRenamed(
        "run_length", "consecutive_failures")


def uptime(rounds: DataFrame, as_of, hours: float = 24, ts: str = "check_ts") -> DataFrame:
    """Healthy share of rounds in percent over the window; 100 when there are none."""
    r = since(rounds, as_of, hours=hours, ts=ts)
    return r.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("status") == "healthy").alias("healthy_checks"),
    ).withColumn("uptime_percentage",
                 F.coalesce(F.try_divide(F.col("healthy_checks") * 100.0, F.col("total_checks")), F.lit(100.0)))


def recent_issues(rounds: DataFrame, checks: DataFrame, as_of, hours: float = 24, n: int = 10) -> DataFrame:
    """The last ``n`` non-healthy rounds in the window with their failing dependencies."""
    bad = since(rounds, as_of, hours=hours, ts="check_ts").filter(F.col("status") != "healthy")
    last = bad.orderBy(F.col("check_ts").desc()).limit(n)
    failing = (checks.filter(F.col("status") != "healthy")
               .join(last.select("check_ts"), "check_ts", "left_semi")
               .groupBy("check_ts")
               .agg(F.array_join(F.array_sort(F.collect_set("dependency")), ",").alias("dependencies")))
    return last.drop("dependencies").join(failing, "check_ts", "left")


def readiness(checks: DataFrame, rounds: DataFrame, critical: Sequence[str]) -> DataFrame:
    """Ready when every critical dependency's latest status is healthy and the
    latest round is healthy or degraded."""
    latest_dep = checks.groupBy("dependency").agg(F.max_by("status", F.struct("ts", "check_id")).alias("status"))
    crit = latest_dep.filter(F.col("dependency").isin(list(critical))).agg(
        F.coalesce(F.bool_and(F.col("status") == "healthy"), F.lit(True)).alias("critical_ok"))
    latest_round = rounds.agg(F.max_by("status", "check_ts").alias("current_status"))
    return crit.crossJoin(latest_round).withColumn(
        "ready", F.col("critical_ok") & F.col("current_status").isin("healthy", "degraded"))


def health_summary(checks: DataFrame, rounds: DataFrame, as_of) -> DataFrame:
    """Latest status and time, uptime, number of recent issues, latest status per dependency."""
    latest = rounds.agg(F.max_by("status", "check_ts").alias("current_status"),
                        F.max("check_ts").alias("last_check"))
    up = uptime(rounds, as_of).select("uptime_percentage", "total_checks")
    issues = recent_issues(rounds, checks, as_of).agg(F.count(F.lit(1)).alias("recent_issues"))
    deps = checks.groupBy("dependency").agg(F.max_by("status", F.struct("ts", "check_id")).alias("s")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("dependency", F.lit("="), "s"))), ",")
        .alias("dependency_status"))
    return latest.crossJoin(up).crossJoin(issues).crossJoin(deps)


# ---------------------------------------------------------------------------
# resource bands
# ---------------------------------------------------------------------------
# FIXED VALUES — resource bands: (resource, degraded above, unhealthy above), percent
RESOURCE_BANDS = [("memory", 80.0, 90.0), ("disk", 85.0, 95.0), ("cpu", 85.0, 95.0)]


def resource_status(readings: DataFrame, bands=RESOURCE_BANDS) -> DataFrame:
    """Status of each resource reading by its band (strictly above a limit)."""
    spark = readings.sparkSession
    band = spark.createDataFrame(bands, "resource string, degraded double, unhealthy double")
    return readings.join(F.broadcast(band), "resource").withColumn(
        "status", F.when(F.col("percent") > F.col("unhealthy"), "unhealthy")
                   .when(F.col("percent") > F.col("degraded"), "degraded").otherwise("healthy")
    ).withColumn("message", F.format_string("%s usage: %.1f%%", F.initcap("resource"), F.col("percent").cast("double")))


def pressure_report(readings: DataFrame, memory_limit_gb: float = 2.0) -> DataFrame:
    """Per reading round: issues (memory over limit, disk > 90) and warnings
    (memory > 80 % of the limit, disk > 80, CPU > 90); healthy when no issue."""
    mem, disk, cpu = (F.col(c).cast("double") for c in ("memory_gb", "disk_percent", "cpu_percent"))
    issues = F.array_compact(F.array(
        F.when(mem > memory_limit_gb, F.format_string(f"Memory usage (%.2fGB) exceeds limit ({memory_limit_gb}GB)", mem)),
        F.when(disk > 90, F.format_string("Low disk space: %.1f%% used", disk))))
    warnings = F.array_compact(F.array(
        F.when((mem <= memory_limit_gb) & (mem > memory_limit_gb * 0.8),
               F.format_string(f"Memory usage (%.2fGB) approaching limit ({memory_limit_gb}GB)", mem)),
        F.when(cpu > 90, F.format_string("High CPU usage: %.1f%%", cpu)),
        F.when((disk <= 90) & (disk > 80), F.format_string("Disk space warning: %.1f%% used", disk))))
    return readings.withColumn("issues", issues).withColumn("warnings", warnings).withColumn(
        "healthy", F.size("issues") == 0)


def sustained_breach(df: DataFrame, partition: Sequence[str], flag, span_seconds: int,
                     order: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows where the breach flag has held continuously for at least ``span_seconds``.

    The span runs from the first breaching reading of the run.  Gaps and
    islands: a run starts where its length is 1, and the current start is the
    running maximum of those times, so the scan scales like ``prefix_agg``.
    """
    d = df.withColumn("_breach", flag).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    d = row_pieces(d, partition, order)
    d = islands(d, partition, list(order), "_breach", "_piece")
    d = prefix_agg(d, partition, list(order), "_piece", {"_start": ("max", F.when(F.col("run_length") == 1, F.col("_us")))})
    return d.withColumn(
        "breach_seconds", F.when(F.col("_breach"), (F.col("_us") - F.col("_start")) / 1e6).otherwise(F.lit(0.0))
    ).withColumn("sustained", F.col("_breach") & (F.col("breach_seconds") >= span_seconds)).drop(
        "_breach", "_us", "_start", "run_length", "_piece")
