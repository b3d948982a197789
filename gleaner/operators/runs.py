"""Run-level quality: metric rows, summaries, trends, SLAs, bands, business figures.

Input: a run table with one row per clustering run
``(run_ts, algorithm, items, clusters, noise, silhouette, coherence,
source_diversity, noise_ratio, quality_score, processing_time, memory_gb,
fallback_used, is_valid)``.  Run tables hold one row per run, so windows over
them are small; everything that touches raw events is a grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from .metrics import since
from .series import trend_label

QUALITY_METRICS = ["silhouette", "coherence", "source_diversity", "noise_ratio", "quality_score"]


def quality_log(runs: DataFrame, metrics=tuple(QUALITY_METRICS) + ("is_valid",)) -> DataFrame:
    """One row per (run, metric); booleans become 0/1; nulls are skipped."""
    cols = [F.struct(F.lit(m).alias("metric"),
                     (F.col(m).cast("int") if dict(runs.dtypes)[m] == "boolean" else F.col(m)).cast("double")
                     .alias("value")) for m in metrics]
    return (runs.select("run_ts", F.explode(F.array(*cols)).alias("m"))
                .select("run_ts", "m.metric", "m.value").filter(F.col("value").isNotNull()))


def recent_averages(runs: DataFrame, n: int = 10, metrics=("silhouette", "coherence", "quality_score", "noise_ratio")) -> DataFrame:
    """Mean of each metric over the last ``n`` runs (nulls skipped)."""
    last = runs.orderBy(F.col("run_ts").desc()).limit(n)
    return last.agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics])


def quality_summary(runs: DataFrame, n: int = 10) -> DataFrame:
    """Latest run's metrics, recent averages and the limits in force."""
    latest = runs.agg(*[F.max_by(m, "run_ts").alias(f"current_{m}") for m in QUALITY_METRICS],
                      F.max("run_ts").alias("last_run"), F.count(F.lit(1)).alias("history_count"))
    lim = P.VALIDATION
    limits = [F.lit(lim["min_silhouette"]).alias("min_silhouette"), F.lit(lim["max_noise_ratio"]).alias("max_noise_ratio"),
              F.lit(lim["min_coherence"]).alias("min_coherence"),
              F.lit(lim["min_source_diversity"]).alias("min_source_diversity"),
              F.lit(lim["min_score"]).alias("min_overall_quality_score")]
    return latest.crossJoin(recent_averages(runs, n)).select("*", *limits)


def trend_stats(log: DataFrame, as_of=None, hours: float | None = None) -> DataFrame:
    """W04 + W05 per metric of a quality log: current (last), average, trend,
    volatility (population std, 0 for a single value)."""
    d = log if hours is None else since(log, as_of, hours=hours, ts="run_ts")
    w = Window.partitionBy("metric").orderBy("run_ts")
    d = d.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("metric")))
    first = F.col("_i") < F.floor(F.col("_n") / 2)
    g = d.groupBy("metric").agg(
        F.max_by("value", "run_ts").alias("current"), F.avg("value").alias("average"),
        F.stddev_pop("value").alias("_std"), F.count(F.lit(1)).alias("points"),
        F.avg(F.when(first, F.col("value"))).alias("_first_mean"),
        F.avg(F.when(~first, F.col("value"))).alias("_second_mean"))
    return g.select("metric", "current", "average", "points",
                    trend_label(F.col("_first_mean"), F.col("_second_mean"), F.col("points")).alias("trend"),
                    F.when(F.col("points") > 1, F.col("_std")).otherwise(F.lit(0.0)).alias("volatility"))


# FIXED VALUES — quality bands (lower bound inclusive, upper exclusive)
QUALITY_LEVELS = [(0.8, 1.0, "Excellent"), (0.6, 0.8, "Good"), (0.4, 0.6, "Fair"), (0.2, 0.4, "Poor"), (0.0, 0.2, "Very Poor")]


def quality_level(score: Column) -> Column:
    """Five half-open bands of 0.2; 'Unknown' outside them (1.0 itself is outside)."""
    out = F.lit("Unknown")
    for lo, hi, name in reversed(QUALITY_LEVELS):
        out = F.when((score >= lo) & (score < hi), F.lit(name)).otherwise(out)
    return out


def issue_type(issue: Column) -> Column:
    """First keyword that occurs, case-blind; else 'other'."""
    low = F.lower(issue)
    out = F.lit("other")
    for k in reversed(["silhouette", "coherence", "diversity", "noise"]):
        out = F.when(F.instr(low, k) > 0, F.lit(k)).otherwise(out)
    return out


def run_issues(runs: DataFrame) -> DataFrame:
    """Threshold issues of each run (the validation rules), one row per issue."""
    lim = P.VALIDATION
    issues = F.array_compact(F.array(
        F.when(F.col("silhouette") < lim["min_silhouette"],
               F.format_string("Low silhouette score: %.3f < %.3f", F.col("silhouette"), F.lit(lim["min_silhouette"]))),
        F.when(F.col("noise_ratio") > lim["max_noise_ratio"],
               F.format_string("High noise ratio: %.3f > %.3f", F.col("noise_ratio"), F.lit(lim["max_noise_ratio"]))),
        F.when(F.col("coherence") < lim["min_coherence"],
               F.format_string("Low cluster coherence: %.3f < %.3f", F.col("coherence"), F.lit(lim["min_coherence"]))),
        F.when(F.col("source_diversity") < lim["min_source_diversity"],
               F.format_string("Low source diversity: %.3f < %.3f", F.col("source_diversity"),
                               F.lit(lim["min_source_diversity"]))),
    ))
    return runs.withColumn("issues", issues)


# FIXED VALUES — recommendation given with an issue of a type (none for the others)
RECOMMENDATIONS = {
    "silhouette": "Consider adjusting clustering parameters or using different algorithm",
    "coherence": "Clusters may be too loose. Consider stricter parameters",
    "diversity": "Clusters may be biased toward specific sources",
}


def recommendation(kind: Column) -> Column:
    """The recommendation for an issue type; null when there is none."""
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in RECOMMENDATIONS.items()])


def issue_counts(runs: DataFrame) -> DataFrame:
    """Issues by type over all runs, and how many recommendations came with them."""
    ex = run_issues(runs).select(F.explode("issues").alias("issue")).withColumn("issue_type", issue_type(F.col("issue")))
    return ex.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issues"),
                                        F.count(recommendation(F.col("issue_type"))).alias("recommendations"))


def run_quality_alerts(runs: DataFrame, min_score: float = 0.2, max_issues: int = 3) -> DataFrame:
    """Runs with score < min_score, or more than ``max_issues`` issues (first 3 kept)."""
    d = run_issues(runs)
    low = d.filter(F.col("quality_score") < min_score).select(
        "run_ts", F.lit("low_quality_score").alias("alert"), F.array_join(F.slice("issues", 1, 3), "; ").alias("detail"))
    many = d.filter(F.size("issues") > max_issues).select(
        "run_ts", F.lit("many_issues").alias("alert"), F.array_join(F.slice("issues", 1, 3), "; ").alias("detail"))
    return low.unionByName(many)


def validation_failed(runs: DataFrame) -> DataFrame:
    """Alert rows for invalid runs with their first three issues."""
    d = run_issues(runs).filter(~F.col("is_valid"))
    return d.select("run_ts", F.format_string("Clustering validation failed with %d issues", F.size("issues")).alias("message"),
                    F.array_join(F.slice("issues", 1, 3), "; ").alias("first_issues"), "quality_score")


def run_metrics(runs: DataFrame) -> DataFrame:
    """One run result → timing, counter and gauge rows tagged by algorithm."""
    rows = [
        ("clustering.processing.duration", "histogram", F.col("processing_time")),
        ("clustering.processing.count", "counter", F.lit(1.0)),
        ("clustering.quality.silhouette_score", "gauge", F.col("silhouette")),
        ("clustering.quality.coherence", "gauge", F.col("coherence")),
        ("clustering.quality.overall_score", "gauge", F.col("quality_score")),
        ("clustering.clusters.count", "gauge", F.col("clusters").cast("double")),
        ("clustering.items.total", "gauge", F.col("items").cast("double")),
        ("clustering.items.noise", "gauge", F.col("noise").cast("double")),
        ("clustering.quality.noise_ratio", "gauge",
         F.when(F.col("items") > 0, F.col("noise") / F.col("items"))),
    ]
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("metric_type"), v.cast("double").alias("value"))
                    for n, t, v in rows])
    return (runs.select("run_ts", "algorithm", F.explode(arr).alias("m"))
                .select("run_ts", "algorithm", "m.name", "m.metric_type", "m.value")
                .filter(F.col("value").isNotNull()))


def business_metrics(runs: DataFrame) -> DataFrame:
    """Success, items per second, mean cluster size, data quality per run."""
    return runs.select(
        "run_ts", (F.col("clusters") > 0).alias("success"),
        F.try_divide(F.col("items"), F.col("processing_time")).alias("items_per_second"),
        F.try_divide(F.col("items"), F.col("clusters")).alias("mean_cluster_size"),
        (1.0 - F.try_divide(F.col("noise"), F.col("items"))).alias("data_quality"))


def throughput(runs: DataFrame) -> DataFrame:
    """items/s and items/min over all runs; null when no time was spent."""
    s = runs.agg(F.sum("items").alias("items"), F.sum("processing_time").alias("seconds"))
    ips = F.when(F.col("seconds") > 0, F.col("items") / F.col("seconds"))
    return s.select("items", "seconds", ips.alias("items_per_second"), (ips * 60.0).alias("items_per_minute"))


def fallback_rate(runs: DataFrame) -> DataFrame:
    """Runs by algorithm, share that fell back, mean time."""
    return runs.groupBy("algorithm").agg(
        F.count(F.lit(1)).alias("runs"),
        (F.count_if("fallback_used") / F.count(F.lit(1))).alias("fallback_share"),
        F.avg("processing_time").alias("mean_seconds"))


# FIXED VALUES — baseline bands (metric, base, good/warning, excellent/critical, higher_is_better)
BASELINES = [
    ("processing_time_p50", 15.0, 25.0, 30.0, False),
    ("memory_gb", 0.5, 1.5, 2.0, False),
    ("silhouette", 0.3, 0.5, 0.7, True),
    ("noise_ratio", 0.2, 0.25, 0.3, False),
    ("coherence", 0.4, 0.6, 0.8, True),
    ("cache_hit_rate", 0.7, 0.8, 0.9, True),
    ("items_per_minute", 10.0, 20.0, 40.0, True),
    ("cpu_percent", 50.0, 80.0, 95.0, False),
    ("disk_percent", 70.0, 85.0, 95.0, False),
]


def baseline_table(spark):
    return spark.createDataFrame(BASELINES, "metric string, base double, mid double, top double, higher_is_better boolean")


def baseline_band(values: DataFrame, bands: DataFrame) -> DataFrame:
    """Classify each (metric, value) against its bands (broadcast range lookup)."""
    j = values.join(F.broadcast(bands), "metric")
    v, hib = F.col("value"), F.col("higher_is_better")
    band = (F.when(hib & (v >= F.col("top")), "excellent").when(hib & (v >= F.col("mid")), "good")
             .when(hib & (v >= F.col("base")), "baseline").when(hib, "below_baseline")
             .when(v >= F.col("top"), "critical").when(v >= F.col("mid"), "warning")
             .when(v > F.col("base"), "above_baseline").otherwise("normal"))
    return j.withColumn("band", band)


def baseline_delta(values: DataFrame, bands: DataFrame) -> DataFrame:
    """Value minus its stored baseline."""
    return values.join(F.broadcast(bands.select("metric", "base")), "metric").withColumn(
        "delta", F.col("value") - F.col("base"))


# FIXED VALUES — SLA rows: name, metric, target, window hours, kind (min/max)
SLAS = [
    ("availability", "uptime_percent", 99.5, 720, "min"),
    ("processing_time_p95", "processing_time", 30.0, 24, "max_p95"),
    ("memory_usage", "memory_gb", 2.0, 24, "max"),
    ("silhouette_score", "silhouette", 0.2, 168, "min_avg"),
    ("noise_ratio", "noise_ratio", 0.3, 168, "max_avg"),
    ("success_rate", "success_percent", 95.0, 24, "min_avg"),
    ("cache_efficiency", "cache_percent", 70.0, 24, "min_avg"),
]


def sla_report(metric_rows: DataFrame, slas: DataFrame, as_of) -> DataFrame:
    """Observed vs target for each SLA over its own window.

    ``metric_rows(ts, metric, value)`` ⋈ SLA rows on metric with
    ``ts >= as_of − window`` (broadcast SLA table), then one aggregate per SLA.
    Every SLA is reported: without points it has no observation and is not
    met.  A p95 is the value at rank min(floor(0.95·n), n − 1).
    """
    from .series import value_at_rank
    j = metric_rows.filter(F.col("value").isNotNull()).join(F.broadcast(slas), "metric").filter(
        F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.col("window_hours").cast("int")))
    g = j.groupBy("sla", "metric", "target", "kind").agg(
        F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"),
        F.count(F.lit(1)).alias("points"))
    p95 = None
    for r in slas.filter(F.col("kind").endswith("p95")).select("sla").collect():  # configuration rows
        one = value_at_rank(j.filter(F.col("sla") == r.sla), "value",
                            F.least(F.floor(F.col("_n") * 0.95), F.col("_n") - 1)).select(
            F.lit(r.sla).alias("sla"), F.col("value").alias("p95")).limit(1)
        p95 = one if p95 is None else p95.unionByName(one)
    g = slas.select("sla", "metric", "target", "kind").join(g.drop("metric", "target", "kind"), "sla", "left")
    g = g.join(p95, "sla", "left") if p95 is not None else g.withColumn("p95", F.lit(None).cast("double"))
    g = g.withColumn("points", F.coalesce("points", F.lit(0)))
    observed = (F.when(F.col("kind").endswith("p95"), F.col("p95"))
                 .when(F.col("kind").isin("min_avg", "max_avg"), F.col("avg_value"))
                 .when(F.col("kind") == "max", F.col("max_value"))
                 .when(F.col("kind") == "min", F.col("min_value"))
                 .otherwise(F.col("avg_value")))
    met = (F.when(F.col("kind").startswith("min"), F.col("observed") >= F.col("target"))
            .otherwise(F.col("observed") <= F.col("target")))
    return g.withColumn("observed", observed).withColumn("met", F.coalesce(met, F.lit(False)))


def service_status(health_ok: DataFrame, memory: DataFrame, quality: DataFrame,
                   memory_limit_gb: float = 2.0, min_quality: float = 0.3) -> DataFrame:
    """Ok when health is ok and memory is below the limit and quality above the floor."""
    return health_ok.crossJoin(memory).crossJoin(quality).withColumn(
        "service_ok", F.col("health_ok") & (F.col("memory_gb") < memory_limit_gb) & (F.col("quality_score") > min_quality))


def diversity_alerts(runs: DataFrame, min_source_diversity: float = P.VALIDATION["min_source_diversity"]) -> DataFrame:
    """The four diversity gauges per run (a null one gives no row), with an alert when
    source diversity is low."""
    g = runs.select("run_ts", F.explode(F.array(*[
        F.struct(F.lit(f"quality.diversity.{n}").alias("gauge"), F.col(f"{n}_diversity").cast("double").alias("value"))
        for n in ("source", "cluster_size", "temporal", "topic")
    ])).alias("g")).select("run_ts", "g.gauge", "g.value").filter(F.col("value").isNotNull())
    return g.withColumn("alert", (F.col("gauge") == "quality.diversity.source") & (F.col("value") < min_source_diversity))
