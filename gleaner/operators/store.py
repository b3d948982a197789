"""Embedding store: keyed entries on a shared file system, hit/miss lookups, eviction.

The store is a parquet table ``(key, model, embedding, created_at, size_bytes)``
partitioned by ``model``; lookups are semi/anti joins on the content key, so
the store never passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from .series import prefix_agg


def write_store(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Append entries to the store (partitioned by model)."""
    entries.write.mode(mode).partitionBy("model").parquet(path)


def read_store(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The store, pruned to one model's partition when given."""
    df = spark.read.parquet(path)
    return df.filter(F.col("model") == model) if model else df


def _fresh(store: DataFrame, as_of, ttl_hours: float) -> DataFrame:
    # expired when now > created + ttl
    return store.filter(~(F.lit(as_of).cast("timestamp_ntz") >
                          F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(int(ttl_hours)))))


def cache_hits(requests: DataFrame, store: DataFrame, as_of, ttl_hours: float = P.CACHE_TTL_HOURS) -> DataFrame:
    """Requests whose key has an unexpired entry (left semi join)."""
    return requests.join(_fresh(store, as_of, ttl_hours).select("key"), "key", "left_semi")


def cache_misses(requests: DataFrame, store: DataFrame, as_of, ttl_hours: float = P.CACHE_TTL_HOURS) -> DataFrame:
    """Requests without an unexpired entry (left anti join)."""
    return requests.join(_fresh(store, as_of, ttl_hours).select("key"), "key", "left_anti")


def cache_lookup(requests: DataFrame, store: DataFrame, as_of, ttl_hours: float = P.CACHE_TTL_HOURS) -> DataFrame:
    """J08 in one pass: every request with ``hit`` (an unexpired entry exists); the store
    side is reduced to distinct fresh keys before the join."""
    fresh = _fresh(store, as_of, ttl_hours).select("key").distinct().withColumn("_hit", F.lit(True))
    return requests.join(fresh, "key", "left").withColumn("hit", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def evict_to_size(store: DataFrame, max_bytes: int, target: float = P.CACHE_TRIM_TARGET) -> DataFrame:
    """Once the total passes ``max_bytes``, the oldest entries go until the rest is
    ≤ target·max.  Entry i (oldest first) is evicted iff total − Σ sizes before i > target·max.
    The running sum is two-level (``prefix_agg``), not one global window."""
    tot = store.agg(F.sum("size_bytes").alias("_total"))
    d = prefix_agg(store, [], ["created_at", "key"], None, {"_upto": ("sum", "size_bytes")})
    d = d.crossJoin(F.broadcast(tot))
    before = F.col("_upto") - F.col("size_bytes")
    evict = (F.col("_total") > max_bytes) & (F.col("_total") - before > target * max_bytes)
    return d.withColumn("evicted", evict).drop("_upto", "_total")


def store_stats(store: DataFrame, cleanups: DataFrame | None = None) -> DataFrame:
    """Entries, total size, newest entry, and the last cleanup of the log
    ``cleanups(cleaned_at)`` (null without one)."""
    stats = store.agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("total_bytes"),
                      F.max("created_at").alias("newest"))
    if cleanups is None:
        return stats.withColumn("last_cleanup", F.lit(None).cast("timestamp_ntz"))
    return stats.crossJoin(cleanups.agg(F.max("cleaned_at").alias("last_cleanup")))


def hit_rate(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """A26 form over lookups: hits / requests, 0 when there are none."""
    h = hits.agg(F.count(F.lit(1)).alias("hits"))
    r = requests.agg(F.count(F.lit(1)).alias("requests"))
    return h.crossJoin(r).withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("requests")), F.lit(0.0)))
