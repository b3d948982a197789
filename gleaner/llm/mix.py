"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Time is a sequence of slots, one block of ``block_rows`` documents each. A
source of target weight w = share / period releases its block b (from 0) at
slot floor(b / w), due by ceil((b + 1) / w); of the released blocks the one
with the earliest deadline runs (ties: the source first in name order). After
any number of slots every source then has had its weight's share to within
less than one block. Shares are whole numbers that add up to the period, so
the schedule repeats: one period is worked out, and every block finds its slot
by division. A period of up to ``FOLD`` slots is a fold over them, a longer one
takes two rounds of ranks for each doubling of its length (``_in_rounds``).

Within a source the documents follow the MD5 of doc_id, a fixed shuffle. Their
ranks come from pieces of at most about ``PIECE_ROWS`` rows and the sizes of the
pieces before, so a source with a third of all rows is many tasks.

Every document is scheduled once. A source that is used up leaves its slots
empty; ``on_target`` marks the slots before the first such gap, where the
promise holds for all sources.

Default target: shares in proportion to the square root of a source's rows, by
largest remainders. The period is the power of two, ``PERIOD`` or more, that
gives the smallest source ``LEAST`` slots or more before rounding, whatever the
number of sources. In a period given by the caller, sources below one slot get
one and the others share the rest in proportion.

Edge cases: documents without a source are a source of their own (null); rows
with equal doc_id follow one another by the hash of their columns; null doc_ids
count as the text "null"; a source whose weight is not given is an error, as
is one share less than 1 or a given period of fewer slots than sources. Shares
given without a period make one of their sum. An empty table gives an empty
result. Text plays no part. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

PERIOD, BLOCK_ROWS, PIECE_ROWS = 256, 64, 20_000
LEAST, FOLD = 8, 2048
ADDED = ("block", "row_in_block", "release", "deadline", "slot", "on_target")


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def _totals(docs: DataFrame) -> tuple[int, int]:
    """Rows of ``docs``, and the period of the default target."""
    n, all_roots, least_root = _sizes(docs).agg(F.sum("rows"), F.sum(F.sqrt("rows")), F.min(F.sqrt("rows"))).first()
    period = PERIOD
    while n and period < round(LEAST * all_roots / least_root, 6):
        period *= 2
    return n or 0, period


def sqrt_shares(docs: DataFrame, period: int | None = None) -> DataFrame:
    """(source, rows, share): the default target, by largest remainders."""
    period = period or _totals(docs)[1]
    everything = Window.partitionBy(F.lit(0))  # one row for each source
    up = everything.orderBy("rows", F.col("source").asc_nulls_first())
    s = _sizes(docs).withColumns({"i": F.row_number().over(up) - 1, "w": F.sqrt("rows")})
    s = s.withColumn("rest", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    # the first source that gets a slot in proportion if those below it get one each
    s = s.withColumn("low", F.min(F.when(F.round((period - F.col("i")) * F.col("w") / F.col("rest"), 6) >= 1, F.col("i"))).over(everything))
    s = s.withColumn("above", F.max(F.when(F.col("i") == F.col("low"), F.col("rest"))).over(everything))
    s = s.withColumn("x", F.when(F.col("i") < F.col("low"), 1.0).otherwise(F.round((period - F.col("low")) * F.col("w") / F.col("above"), 6)))
    s = s.withColumn("r", F.row_number().over(everything.orderBy(F.desc(F.col("x") - F.floor("x")), F.col("source").asc_nulls_first())))
    left = F.lit(period) - F.sum(F.floor("x")).over(everything)
    return s.select("source", "rows", (F.floor("x") + F.when(F.col("r") <= left, 1).otherwise(0)).cast("long").alias("share"))


def _in_rounds(shares: DataFrame, period: int) -> DataFrame:
    """``one_period`` for any length, each round a rank of the period's blocks.

    Up: of the blocks released in a segment of 2^h slots, which run there if none
    waits at its start. Those left over by the left half can take any slot of the
    right half, so of them and of what the right half runs by itself the earliest
    deadlines run, as many as it has slots. Bit h of ``done`` keeps the answer.
    Down: of a segment's blocks, the left half runs the earliest deadlines of those
    released before the segment and those that it runs by itself.
    """
    ok = F.expr(f"""CASE WHEN sum(share) OVER () <> {period} OR min(coalesce(share, 0)) OVER () < 1
        THEN raise_error('shares must be whole, 1 or more and add up to the period') ELSE TRUE END""")
    s = shares.select("source", F.col("share").cast("long").alias("share"), F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_first())).alias("i"), ok.alias("ok")).filter("ok")
    s = s.withColumn("part", F.explode(F.expr("sequence(0L, (share - 1) DIV 4096)")))
    s = s.withColumn("j", F.explode(F.expr("sequence(part * 4096, least(part * 4096 + 4095, share - 1))")))
    s = s.select("source", "share", "i", "j", F.expr(f"j * {period} DIV share").alias("r"), F.expr(f"((j + 1) * {period} + share - 1) DIV share").alias("d"))
    first = F.row_number().over(Window.partitionBy("r").orderBy("d", "i"))
    s = materialize(s.withColumn("now", first == 1).withColumn("done", F.col("now").cast("long")), "mix_blocks")
    levels = (period - 1).bit_length()
    rank = F.row_number().over(Window.partitionBy("seg", "in_turn").orderBy("d", "i"))
    for h in range(1, levels):
        half = 1 << h - 1
        s = s.withColumns({"seg": F.shiftright("r", h), "left": F.col("r").bitwiseAND(half) == 0})
        s = s.withColumn("in_turn", F.col("left") != F.col("now")).withColumn("rank", rank)
        slots = F.least(F.lit(period), (F.col("seg") + 1) * (2 * half)) - F.col("seg") * (2 * half) - half
        s = s.withColumn("now", F.when(F.col("in_turn"), F.col("rank") <= slots).otherwise(F.col("left")))
        s = s.withColumn("done", F.col("done").bitwiseOR(F.when(F.col("now"), F.lit(1 << h)).otherwise(F.lit(0)).cast("long")))
    s = materialize(s.select("source", "share", "i", "j", "r", "d", "done", F.lit(0).cast("long").alias("seg")), "mix_runs")
    for h in range(levels, 0, -1):
        half, start = 1 << h - 1, F.col("seg") * (1 << h)
        own = (F.col("r") < start + half) & (F.col("done").bitwiseAND(half) != 0)
        s = s.withColumn("in_turn", (F.col("r") < start) | own).withColumn("rank", rank)
        slots = F.least(F.lit(period), start + half) - start
        s = s.withColumn("seg", F.col("seg") * 2 + F.when(F.col("in_turn") & (F.col("rank") <= slots), 0).otherwise(1)).drop("in_turn", "rank")
    return materialize(s.select("source", "share", F.col("seg").alias("t"), "j"), "mix_slots")


def one_period(shares: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, share, j, t): the slot t of a source's j-th block in a period, earliest deadline first."""
    if period > FOLD:
        return _in_rounds(shares, period)
    rows = shares.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", F.col("share").cast("long").alias("share")))).alias("s"))
    rows = rows.withColumn("ok", F.expr(f"""CASE WHEN size(s) > 0 AND (aggregate(s, 0L, (a, x) -> a + x.share) <> {period}
        OR exists(s, x -> x.share IS NULL OR x.share < 1)) THEN raise_error('shares must be whole, 1 or more and add up to the period') ELSE TRUE END"""))
    key = f"""array_min(transform(s, (x, i) -> CASE
        WHEN st.served[i] < x.share AND st.served[i] * {period} DIV x.share <= t
        THEN ((st.served[i] + 1) * {period} + x.share - 1) DIV x.share * {period} + i END))"""
    fold = F.expr(f"""aggregate(sequence(0, {period - 1}),
        named_struct('served', transform(s, x -> 0L), 'slots', cast(array() AS array<long>)),
        (st, t) -> element_at(transform(array({key} % {period}), p -> named_struct(
            'served', transform(st.served, (v, i) -> IF(i = p, v + 1, v)),
            'slots', array_append(st.slots, p))), 1)).slots""")
    slots = rows.filter("ok and size(s) > 0").select("s", F.posexplode(fold).alias("t", "p"))
    slots = slots.select(F.expr("s[int(p)].source").alias("source"), F.expr("s[int(p)].share").alias("share"), "t")
    return slots.withColumn("j", F.row_number().over(Window.partitionBy("source").orderBy("t")) - 1)


def schedule(docs: DataFrame, shares: DataFrame | None = None, period: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` plus block, row_in_block, release, deadline, slot (long) and on_target.

    ``shares``: (source, share), whole slots in a period for each source.
    Reading in the order (slot, row_in_block) gives the mix.
    """
    total, long_enough = _totals(docs)
    if period is None:
        period = long_enough if shares is None else int(shares.agg(F.sum("share")).first()[0] or 1)
    target = sqrt_shares(docs, period) if shares is None else _sizes(docs).join(
        shares.select(F.col("source").alias("_s"), "share"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    slots = one_period(target, period)
    # the first slot that lacks its block
    gap = target.agg(F.min(F.expr(f"((rows + {block_rows - 1}) DIV {block_rows}) * {period} DIV share")).alias("_gap"))

    digits = 1
    while total / 16 ** digits > PIECE_ROWS:
        digits += 1
    names = [c for c in docs.columns if c not in ADDED]
    d = docs.select(*names, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("_md5"), F.xxhash64(*names).alias("_tie"))
    d = d.withColumn("_piece", F.substring("_md5", 1, digits))
    sizes = d.groupBy("source", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("source", F.col("_piece").alias("_p"), (F.sum("_n").over(
        Window.partitionBy("source").orderBy("_piece")) - F.col("_n")).alias("_before"))
    share = target.select(F.col("source").alias("_s"), F.col("share").alias("_share"))
    before = before.join(share, F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    rank = F.row_number().over(Window.partitionBy("source", "_piece").orderBy("_md5", "_tie"))
    d = d.withColumn("_in_piece", rank - 1).join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
    d = d.withColumn("_rank", F.col("_before") + F.col("_in_piece"))
    d = d.withColumns({"block": F.expr(f"_rank DIV {block_rows}"), "row_in_block": F.expr(f"_rank % {block_rows}")}).drop("_s", "_p")
    d = d.withColumn("_j", F.expr("block % _share"))
    own = slots.select(F.col("source").alias("_s"), F.col("j").alias("_k"), F.col("t").alias("_t"))
    own = F.broadcast(own) if period <= FOLD else own  # `period` rows
    d = d.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_j") == F.col("_k")))
    d = d.crossJoin(F.broadcast(gap)).withColumns({  # one row
        "release": F.expr(f"block * {period} DIV _share"),
        "deadline": F.expr(f"((block + 1) * {period} + _share - 1) DIV _share"),
        "slot": F.expr(f"(block DIV _share) * {period} + _t")})
    return d.withColumn("on_target", F.col("slot") < F.col("_gap")).select(*names, *ADDED)


def report(docs: DataFrame) -> DataFrame:
    return schedule(docs.select("doc_id", "source"))


ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS rows, sqrt(count(*)) AS w FROM documents GROUP BY 1),
per AS (SELECT min(p) AS period FROM (SELECT {PERIOD} * (1::BIGINT << unnest(range(0, 40))) AS p)
  WHERE p >= (SELECT round({LEAST} * sum(w) / min(w), 6) FROM n)),
u AS (SELECT *, row_number() OVER up - 1 AS i, sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM n, per WINDOW up AS (ORDER BY rows, source NULLS FIRST)),
lo AS (SELECT i AS low, rest AS above FROM u WHERE round((period - i) * w / rest, 6) >= 1 ORDER BY i LIMIT 1),
x AS (SELECT source, rows, period, CASE WHEN i < low THEN 1.0::DOUBLE ELSE round((period - low) * w / above, 6) END AS x FROM u, lo),
s AS (SELECT source, rows, period, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, source NULLS FIRST)
        <= period - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share,
      row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM x),
c AS (SELECT list(share ORDER BY i) AS cs, any_value(period) AS period FROM s),
edf AS (
  SELECT -1::BIGINT AS t, NULL::BIGINT AS p, list_transform(cs, lambda y: 0::BIGINT) AS served, cs, period FROM c
  UNION ALL
  SELECT t + 1, p2, list_transform(served, lambda v, i: CASE WHEN i = p2 THEN v + 1 ELSE v END), cs, period
  FROM (SELECT *, list_min(list_filter(list_transform(served, lambda v, i: CASE
          WHEN v < cs[i] AND v * period // cs[i] <= t + 1 THEN ((v + 1) * period + cs[i] - 1) // cs[i] * 100000 + i END),
          lambda y: y IS NOT NULL)) % 100000 AS p2 FROM edf WHERE t < period - 1)),
slots AS (SELECT s.source, share, s.period, t, row_number() OVER (PARTITION BY s.source ORDER BY t) - 1 AS j FROM edf JOIN s ON edf.p = s.i),
gap AS (SELECT min(((rows + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) * period // share) AS gap FROM s),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null'))) - 1 AS rank FROM documents),
b AS (SELECT doc_id, source, rank // {BLOCK_ROWS} AS block, rank % {BLOCK_ROWS} AS row_in_block FROM r)
SELECT doc_id, b.source, block, row_in_block, block * period // share AS release,
  ((block + 1) * period + share - 1) // share AS deadline, CAST((block // share) * period + t AS BIGINT) AS slot,
  (block // share) * period + t < gap AS on_target
FROM b JOIN slots ON b.source IS NOT DISTINCT FROM slots.source AND block % share = j, gap
"""
