"""Connected components of a link table by star rounds that split hubs, and joins that split hot keys.

Every round links each node's larger neighbours to the least of its
neighbourhood (large star), then the node and its smaller neighbours to the least
of them (small star), until the links no longer change: the answer is exact, and
a chain takes a logarithmic number of rounds. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, measured

#: A key is hot if it has more than ``HOT_ROWS`` rows and one of ``HOT_SHARE`` of all: fewer keys than HOT_SHARE are.
HOT_SHARE, HOT_ROWS = 500, 1 << 14


def hot_keys(stats: DataFrame, total: int, size: str = "c") -> DataFrame | None:
    """The rows of ``stats`` (one row a key) with hot keys, ``HOT_SHARE`` at most, as a local table; None without any."""
    if total <= HOT_ROWS:
        return None
    hot = stats.filter(F.col(size) > max(HOT_ROWS, total // HOT_SHARE)).collect()
    return stats.sparkSession.createDataFrame(hot, stats.schema) if hot else None


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], total: int, size: str = "c") -> DataFrame:
    """``rows`` with the columns of the written ``stats`` (one row a key, ``size`` its number of rows; inner join).

    Hot keys' stats are broadcast, so no task gets a hot key's rows.
    """
    hot = hot_keys(stats, total, size)
    if hot is None:
        return rows.join(stats, keys)
    mark = F.broadcast(hot.select(*keys))
    return (rows.join(mark, keys, "left_anti").join(stats.join(mark, keys, "left_anti"), keys)
            .unionByName(rows.join(F.broadcast(hot), keys)))


def _least(e: DataFrame, n: int) -> DataFrame:
    """(u, v) with ``m``: the least v of each u."""
    least = F.min("v").over(Window.partitionBy("u"))
    hot = hot_keys(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), n) if n > HOT_ROWS else None
    if hot is None:
        return e.withColumn("m", least)
    hot = F.broadcast(hot.select("u", "m"))
    return e.join(hot.select("u"), "u", "left_anti").withColumn("m", least).unionByName(e.join(hot, "u"))


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    e, seen = measured(e, "links", h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    return e, (seen["n"], seen["h"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v: long, any direction, repeats and loops allowed) -> (node, root).

    root is the smallest node reachable. Nodes without links don't appear. An
    empty link table gives an empty result.
    """
    e, seen = _written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())  # u > v
    while seen[0]:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        large = (_least(both, 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v"))
        if 2 * seen[0] > HOT_ROWS:
            large = materialize(large.distinct(), "links")  # read twice below
        e, now = _written(_least(large, seen[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                                                        .alias("x")).select("x.u", "x.v").filter("u != v").distinct())
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
