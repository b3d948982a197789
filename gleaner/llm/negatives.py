"""Hard-negative mining by Strassen products of integer tiles and mergeable heaps.

Every component becomes floor(256 * x) as an int64. Anchors are cut into blocks
of ``ANCHOR_ROWS`` and all rows into tiles of ``TILE_ROWS``; every (block, tile)
pair is one bounded group, in which Strassen's recursion (seven half-size
products, odd sides padded with zeros, integer additions) gives the scores.

* Positive heaps: per label, the block's anchors of that label times the tile's
  rows of that label; each anchor keeps its best ``positives`` rows of the tile.
* Window heaps: the block times the whole tile; each (anchor, positive) keeps its
  best ``negatives`` rows of another label between ``low`` and ``high`` percent
  of the positive's score.

Heaps of one anchor are merged by a window group limit: each task sends its best
few, whatever the number of tiles. Anchors are a share of the rows, so the work
is that share of all pairs, in blocks; no row is left out and no pair emitted.

Edge cases: rows with a null label, a null vector, or any null or non-finite
component take no part. A null vec_id is no anchor and comes last among ties.
Rows with the anchor's own vec_id are not its positives; rows with equal vec_id
are otherwise rows of their own, and each such anchor row gives its own result.
Shorter vectors are padded with zeros; components beyond the int64 range take its
nearest end, and sums wrap modulo 2**64. An anchor without positives, and a
positive without rows in its window, give no row. An empty table gives an empty
result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, prepare

ANCHOR_ROWS, TILE_ROWS, LEAF = 1024, 1024, 16
ANCHOR_STEP, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 5, 80, 100


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, exact modulo 2**64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` highest allowed scores; of equal ones the left column."""
    if not scores.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if scores.shape[1] > k:
        s = np.where(allowed, scores, np.iinfo(np.int64).min)
        allowed = allowed & (scores >= np.partition(s, -k, axis=1)[:, -k, None])
    r, c = np.nonzero(allowed)
    order = np.lexsort((c, ~scores[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k]


def window_of(positive: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer between ``low`` and ``high`` percent of a score, without overflow."""
    q, r = np.divmod(positive, 100)
    return low * q - (-low * r) // 100, high * q + high * r // 100


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer rows of a list<double> column; shorter ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(256.0 * flat), -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)
    size = column.value_lengths().to_numpy()
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def _groups(batches, keys: int):
    """Record batches sorted by their first ``keys`` columns -> one table for each key."""
    held = []
    for b in batches:
        k = np.stack([b.column(i).to_numpy() for i in range(keys)])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:]):
            if i == j:
                continue
            part = b.slice(i, j - i)
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in range(keys)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sides(group: pa.Table):
    """Anchors and rows of one group, the rows in the order of ties (vec_id, null last)."""
    anchor = group.column("aid").is_valid()
    a, t = group.filter(anchor), group.filter(pc.invert(anchor))
    t = t.take(pc.sort_indices(t.column("vec_id"), sort_keys=[("vec_id", "ascending")])) if t.num_rows > 1 else t
    x, y = (_matrix(s.column("v").combine_chunks()) if s.num_rows else np.zeros((0, 0), np.int64) for s in (a, t))
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
    la, lt = (s.column("label").to_numpy() for s in (a, t))
    ids = t.column("vec_id")
    known = ids.is_valid().to_numpy()
    own = a.column("vec_id").to_numpy()[:, None] == ids.fill_null(0).to_numpy()[None, :]
    return a, t, x, y, la, lt, own & known[None, :]


def _heap(a: pa.Table, t: pa.Table, r: np.ndarray, c: np.ndarray, s: np.ndarray, **more) -> pa.RecordBatch:
    cols = {"aid": a.column("aid").take(pa.array(r)).combine_chunks(), **{k: pa.array(v) for k, v in more.items()},
            "score": pa.array(s), "vec_id": t.column("vec_id").take(pa.array(c)).combine_chunks()}
    return pa.RecordBatch.from_pydict(cols)


def positive_heaps(k: int):
    def run(batches):
        for g in _groups(batches, 2):
            a, t, x, y, la, lt, own = _sides(g)
            for label in np.intersect1d(la, lt):
                i, j = np.flatnonzero(la == label), np.flatnonzero(lt == label)
                s = strassen(x[i], np.ascontiguousarray(y[j].T))
                r, c = best(s, ~own[np.ix_(i, j)], k)
                yield _heap(a, t, i[r], j[c], s[r, c])
    return run


def window_heaps(k: int, low: int, high: int):
    def run(batches):
        for g in _groups(batches, 2):
            a, t, x, y, la, lt, _ = _sides(g)
            if not a.num_rows or not t.num_rows:
                continue
            s = strassen(x, np.ascontiguousarray(y.T))
            other = la[:, None] != lt[None, :]
            wins = a.column("wins").to_pylist()
            for p in range(max(map(len, wins))):
                i = np.array([n for n, w in enumerate(wins) if len(w) > p])
                lo, hi = window_of(np.array([wins[n][p] for n in i], np.int64), low, high)
                r, c = best(s[i], other[i] & (s[i] >= lo[:, None]) & (s[i] <= hi[:, None]), k)
                yield _heap(a, t, i[r], c, s[i[r], c], place=np.full(len(r), p + 1, np.int32))
    return run


def _tiles(anchors: DataFrame, rows: DataFrame, blocks: int, tiles: int) -> DataFrame:
    """Every (anchor block, tile) as consecutive rows of one partition."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wins = F.col("wins") if "wins" in anchors.columns else F.lit(None).cast("array<long>")
    a = anchors.select(F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int").alias("block"), each(tiles).alias("tile"),
                       "aid", "vec_id", "label", "v", wins.alias("wins"))
    t = rows.select(each(blocks).alias("block"), F.pmod(F.xxhash64("rid"), F.lit(tiles)).cast("int").alias("tile"),
                    F.lit(None).cast("long").alias("aid"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("wins"))
    return (a.unionByName(t).repartition(partitions(rows.sparkSession), "block", "tile").sortWithinPartitions("block", "tile"))


def _ranked(heaps: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """(vec_id, embedding, label) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on vec_id and label; 0 <= low <= high <= 100 are percents.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high are percents, 0 <= low <= high <= 100")
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    rows = materialize(vectors.select("vec_id", "embedding", "label").filter(good).select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
        F.xxhash64(F.col("label").cast("string")).alias("label"), v.alias("v"),
        (F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor")), "vectors")
    anchors = rows.filter("anchor").select(F.col("rid").alias("aid"), "vec_id", "label", "v")
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    blocks, tiles = max(1, math.ceil(m / ANCHOR_ROWS)), max(1, math.ceil(n / TILE_ROWS))
    heaps = _tiles(anchors, rows, blocks, tiles).mapInArrow(positive_heaps(positives), "aid long, score long, vec_id long")
    first = materialize(_ranked(heaps, positives, "aid").select(
        "aid", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most `positives` scores of an anchor, in the order of its places
    wins = first.groupBy("aid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("wins"))
    heaps = _tiles(anchors.join(wins, "aid"), rows, blocks, tiles).mapInArrow(
        window_heaps(negatives, low, high), "aid long, place int, score long, vec_id long")
    found = _ranked(heaps, negatives, "aid", "place").select("aid", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(first, ["aid", "place"]).join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def shifted(vectors: DataFrame) -> DataFrame:
    """The contract's label noise: rows whose vec_id is divisible by 7 take the next label."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def report(vectors: DataFrame) -> DataFrame:
    return mine(shifted(vectors.select("vec_id", "embedding", "label")), F.col("vec_id") % ANCHOR_STEP == 0)


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {ANCHOR_STEP} = 0 AND (b.label <> a.label OR b.vec_id IS DISTINCT FROM a.vec_id)),
p AS MATERIALIZED (
  SELECT * FROM (SELECT aid, anchor_id, own, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s WHERE label = own)
  WHERE place <= {POSITIVES}),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.aid, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON s.aid = p.aid AND s.label <> p.own
    AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
