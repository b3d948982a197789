"""Ordered-series primitives: running aggregates, newest-n, discrete percentiles, trends.

``prefix_agg`` is the workhorse.  A running aggregate over one window
partition per key would put a hot key (say a third of all rows) into a single
task.  Instead rows are cut into (key, piece): a window runs inside each piece,
one small table holds the per-piece totals, and the running total of earlier
pieces is added back by a join.  The result is exact for any associative
aggregate (sum, max, min).  ``row_pieces`` cuts by a range sort, so a task is
bounded by a number of rows however hot a key, or one of its days, is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_PIECE = "_piece"
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def row_pieces(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` plus ``_piece``, which grows with (``partition``, ``order``).

    The rows are range-partitioned by sampled bounds and written to the shared
    checkpoint folder; a row's piece is its range, so pieces hold about equal
    numbers of rows.  ``order`` should be unique: equal rows share a range.
    """
    keys = [F.col(c) for c in partition] + [_c(o) for o in order]
    return written(df.orderBy(*keys).withColumn(_PIECE, F.shiftright(F.monotonically_increasing_id(), 33)), "pieces")


def prefix_agg(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column],
               bucket: str | Column | None, specs: dict[str, tuple[str, str | Column]],
               descending: bool = False) -> DataFrame:
    """Running aggregates over rows ordered by ``order`` within ``partition``.

    ``bucket`` must be monotone in the order; None cuts the rows by
    ``row_pieces``.  ``specs`` maps an output column to ``(fn, value)``, fn in
    sum/max/min; the frame is "all rows up to and including this one".  With
    ``descending`` the series runs from the last row backwards (suffix aggregates).
    """
    if bucket is None:
        return prefix_agg(row_pieces(df, partition, order), partition, order, _PIECE, specs, descending).drop(_PIECE)
    part = list(partition)
    b = "_pa_bucket"
    d = df.withColumn(b, _c(bucket))
    ords = [(_c(o).desc() if descending else _c(o).asc()) for o in order]
    w_in = Window.partitionBy(*part, b).orderBy(*ords).rowsBetween(Window.unboundedPreceding, 0)
    for name, (fn, val) in specs.items():
        d = d.withColumn(f"_in_{name}", _AGG[fn](_c(val)).over(w_in))
    tot = d.groupBy(*part, b).agg(*[_AGG[fn](_c(val)).alias(f"_bt_{name}") for name, (fn, val) in specs.items()])
    border = F.col(b).desc() if descending else F.col(b).asc()
    w_b = Window.partitionBy(*part).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part, b, *[_AGG[fn](F.col(f"_bt_{name}")).over(w_b).alias(f"_off_{name}")
                                  for name, (fn, _v) in specs.items()])
    offs = offs.select(*[F.col(c).alias(f"_k_{c}") for c in [*part, b]], *[f"_off_{name}" for name in specs])
    same = F.lit(True)
    for c in [*part, b]:
        same = same & d[c].eqNullSafe(offs[f"_k_{c}"])
    d = d.join(offs, same, "left").drop(*[f"_k_{c}" for c in [*part, b]])
    for name, (fn, _v) in specs.items():
        inner, off = F.col(f"_in_{name}"), F.col(f"_off_{name}")
        if fn == "sum":
            out = F.coalesce(off, F.lit(0)) + inner
        elif fn == "max":
            out = F.greatest(off, inner)
        else:
            out = F.least(off, inner)
        d = d.withColumn(name, out).drop(f"_in_{name}", f"_off_{name}")
    return d.drop(b)


def keep_last(df: DataFrame, key: Sequence[str], n: int, ts: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """Newest ``n`` rows per key.

    ``row_number() <= n`` over a partition lets Spark insert a per-partition
    group limit before the shuffle, so at most n rows per key and input
    partition cross the network.
    """
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def discrete_percentile(sorted_values: Column, count: Column, p: float) -> Column:
    """sorted[min(floor(p·n), n−1)] on a sorted array (1-based ``element_at``)."""
    idx = F.least(F.floor(F.lit(float(p)) * count), count - 1)
    return F.element_at(sorted_values, (idx + 1).cast("int"))


def trend_label(first_mean: Column, second_mean: Column, n: Column, band: float = 5.0) -> Column:
    """Improving / declining / stable from the mean of each half (split at n//2)."""
    change = F.when(first_mean != 0, (second_mean - first_mean) / first_mean * 100.0).otherwise(F.lit(0.0))
    return (F.when(n < 2, F.lit("stable"))
             .when(change > band, F.lit("improving"))
             .when(change < -band, F.lit("declining"))
             .otherwise(F.lit("stable")))


def islands(df: DataFrame, partition: Sequence[str], order: Sequence[str], flag: str | Column,
            bucket: str | Column | None = None) -> DataFrame:
    """Gaps and islands: ``run_length`` = rows in the current run of true ``flag``.

    0 on rows where the flag is false.  Built from two running aggregates
    (row position and position of the last false row), so it scales like
    ``prefix_agg``.
    """
    if bucket is None:
        return islands(row_pieces(df, partition, order), partition, order, flag, _PIECE).drop(_PIECE)
    d = df.withColumn("_flag", _c(flag).cast("boolean"))
    d = prefix_agg(d, partition, order, bucket, {"_pos": ("sum", F.lit(1))})
    d = prefix_agg(d, partition, order, bucket,
                   {"_last_break": ("max", F.when(~F.col("_flag"), F.col("_pos")).otherwise(F.lit(0)))})
    return (d.withColumn("run_length", F.when(F.col("_flag"), F.col("_pos") - F.col("_last_break")).otherwise(F.lit(0)))
             .drop("_flag", "_pos", "_last_break"))


def value_at_rank(df: DataFrame, value: str, index: Column) -> DataFrame:
    """One-row frame with the value at 0-based rank ``index`` of ``value`` ascending.

    ``index`` may use ``F.col("_n")`` (the row count).  No global sort and no
    single-partition window over the data: values are cut into value-monotone
    buckets, a small table of bucket counts locates the bucket holding the
    rank, and only that bucket is ranked.
    """
    v = F.col(value)
    d = df.select(v.alias("_v")).filter(F.col("_v").isNotNull()).withColumn(
        "_b", F.floor(F.log2(F.abs(F.col("_v")) + 1.0) * 64).cast("long") * F.signum(F.col("_v")).cast("long"))
    n = d.select(F.count(F.lit(1)).alias("_n"))
    tot = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    cum = tot.withColumn("_cum", F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    k = cum.join(n, how="cross").withColumn("_k", index)
    target = k.filter((F.col("_cum") - F.col("_c") <= F.col("_k")) & (F.col("_k") < F.col("_cum"))).select(
        "_b", (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_off"))
    # equal values are counted, not ranked row by row
    vals = d.join(F.broadcast(target), "_b").groupBy("_b", "_off", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_b").orderBy("_v"))
    return vals.withColumn("_upto", upto).filter(
        (F.col("_upto") - F.col("_c") <= F.col("_off")) & (F.col("_off") < F.col("_upto"))).select(F.col("_v").alias(value))


def dense_positions(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` plus ``pos``: 0, 1, 2, ... in the given order, without a global window.

    The rows are range-partitioned and sorted; a row's position is its place in
    its partition plus the sizes of the partitions before (one number for each).
    """
    spark = rows.sparkSession
    s = written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).cast("int")
    sizes = sorted((r.p, r.n) for r in s.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets, "_p int, _off long"))
    return s.join(table, part == F.col("_p")).select(
        *rows.columns, (F.col("_off") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("pos"))
