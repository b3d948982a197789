"""Exact all-pairs vector work without materialising pairs.

Rows are hashed into blocks.  Every (left block,
right block) pair becomes one ``applyInPandas`` group: the left block is
replicated to each right block and vice versa, as in a distributed matrix
product.  A group therefore holds two blocks, never a whole key or table,
and the kernel (NumPy, float64, direct differences where ‖x‖²+‖y‖²−2x·y
would cancel) emits only compact per-row results: the k nearest partners,
per-cluster distance sums, or the pairs above a similarity threshold.
Each row is sent once per block of the other side.  So that the shuffled volume
grows with the rows and not with their square, a table is cut into about
``BLOCKS`` blocks, whose size is bounded by ``BLOCK_BYTES`` of vectors
(``block_size``).  Callers that can accept approximation use
``BucketedRandomProjectionLSH`` instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import dense_positions

_CHUNK = 128

#: Blocks of a table of vectors; rows of a block at least; bytes of a block's vectors at most.
BLOCKS, BLOCK_ROWS, BLOCK_BYTES = 16, 1024, 1 << 26


def block_size(n: int, width: int) -> int:
    """Rows of a block of ``n`` vectors of ``width`` numbers."""
    return max(BLOCK_ROWS, min(math.ceil(n / BLOCKS), BLOCK_BYTES // (8 * max(1, width))))


def extent(df: DataFrame, vec_col: str) -> tuple[int, int]:
    """How many rows, and the greatest length of their vectors."""
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    return n, width or 0


def chunk_rows(m: int, width: int = 1) -> int:
    """Left rows that meet ``m`` right ones at a time (``width`` numbers for each pair)."""
    return max(1, min(_CHUNK, (1 << (21 if width == 1 else 23)) // max(1, m * width)))


def _tagged(df: DataFrame, id_col: str, vec_col: str, tag_col: str | None, n_blocks: int,
            other_blocks: int, side: int, own: Column | None = None) -> DataFrame:
    tag = F.col(tag_col).cast("long") if tag_col else F.lit(0).cast("long")
    d = df.select(F.col(id_col).cast("long").alias("id"),
                  F.transform(vec_col, lambda x: x.cast("double")).alias("vec"),
                  tag.alias("tag"),
                  (F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)) if own is None else own).alias("_own"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))
    if side == 0:
        return d.select("id", "vec", "tag", F.col("_own").alias("bl"), F.col("_other").alias("br"), F.lit(0).alias("side"))
    return d.select("id", "vec", "tag", F.col("_other").alias("bl"), F.col("_own").alias("br"), F.lit(1).alias("side"))


def _pairs_input(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, ltag: str | None, rtag: str | None,
                 block_rows: int | None = None, n: int | tuple[int, int] | None = None, width: int | None = None) -> DataFrame:
    """Both sides dealt to the block pairs; ``n``: the rows of each side (or of both), and ``width``, that of a
    vector, where the caller knows them."""
    if n is None:
        nl, w = extent(left, vec_col)
        nr = nl if right is left else right.count()
        width = w if width is None else width
    else:
        nl, nr = n if isinstance(n, tuple) else (n, n)
    block_rows = block_rows or block_size(max(nl, nr), width or 0)
    bl, br = (max(1, math.ceil(x / block_rows)) for x in (nl, nr))
    return _tagged(left, id_col, vec_col, ltag, bl, br, 0).unionByName(
        _tagged(right, id_col, vec_col, rtag, br, bl, 1))


def _own_pairs_input(df: DataFrame, id_col: str, vec_col: str, block_rows: int | None = None) -> DataFrame:
    """The rows of one table dealt to its block pairs (bl <= br): two blocks meet in one group, not in one
    for each order, and a block meets itself with one copy of its rows (side 0)."""
    n, width = extent(df, vec_col)
    blocks = max(1, math.ceil(n / (block_rows or block_size(n, width))))
    return _tagged(df, id_col, vec_col, None, blocks, blocks, 0).select(
        "id", "vec", "tag", F.least("bl", "br").alias("bl"), F.greatest("bl", "br").alias("br"), (F.col("bl") > F.col("br")).cast("int").alias("side"))


def _split(pdf: pd.DataFrame):
    lft = pdf[pdf["side"] == 0]
    rgt = pdf[pdf["side"] == 1]
    L = np.stack(lft["vec"].to_numpy()) if len(lft) else np.zeros((0, 0))
    R = np.stack(rgt["vec"].to_numpy()) if len(rgt) else np.zeros((0, 0))
    return lft, rgt, L, R


def _dist_chunks(L: np.ndarray, R: np.ndarray):
    step = chunk_rows(len(R), L.shape[1])
    for s in range(0, len(L), step):
        diff = L[s:s + step, None, :] - R[None, :, :]
        yield s, np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


def squared(L: np.ndarray, R: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and a bound of their rounding error.

    Used to find the few candidates whose exact distances are then taken from
    direct differences (``exact_distance``)."""
    x, y = np.einsum("ij,ij->i", L, L), np.einsum("ij,ij->i", R, R)
    S = (-2.0 * L) @ R.T
    S += x[:, None]
    S += y[None, :]
    return S, 1e-13 * L.shape[1] * (x.max(initial=0.0) + y.max(initial=0.0)) + 1e-300


def exact_distance(L: np.ndarray, R: np.ndarray) -> np.ndarray:
    """Distances of row pairs by direct differences."""
    diff = L - R
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def row_cut(S: np.ndarray, k: int) -> np.ndarray:
    """A bound of each row's ``k``-th least entry: that of the least entries of groups of columns."""
    m = S.shape[1]
    g = min(64, m // (4 * k))
    if g > 1:
        S = S[:, :m // g * g].reshape(len(S), g, m // g).min(axis=1)
    return np.partition(S, k - 1, axis=1)[:, k - 1, None]


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true entries, as ``np.nonzero`` gives them; a few among many are found ten times as fast."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def least_of_rows(rows: np.ndarray, cost: np.ndarray, ids: np.ndarray, k: int = 1) -> np.ndarray:
    """Places of the ``k`` entries of each row (of a list of row numbers) with the least (cost, id)."""
    order = np.lexsort((ids, cost, rows))
    r = rows[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


#: Left rows and right rows that ``nearest_ward`` multiplies at a time; candidates measured at a time.
_LEFT, _RIGHT, _MEASURED = 256, 4096, 1 << 16


def _products(L: np.ndarray, R: np.ndarray, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices whose product has the squared distances, and a bound of each left row's rounding error: in single
    precision if their extent is in its range, around the rows' middle."""
    centre = R.mean(axis=0)
    L, R = L - centre, R - centre
    x, y = np.einsum("ij,ij->i", L, L), np.einsum("ij,ij->i", R, R)
    far = max(x.max(initial=0.0), y.max(initial=0.0))
    kind = kind if 1e-24 < far < 1e30 else np.float64
    a, b = np.empty((len(L), L.shape[1] + 2), kind), np.empty((len(R), L.shape[1] + 2), kind)
    a[:, :-2], a[:, -2], a[:, -1] = -2.0 * L, x, 1.0
    b[:, :-2], b[:, -2], b[:, -1] = R, 1.0, y
    return a, b, 4.0 * (L.shape[1] + 8) * np.finfo(kind).eps * (x + y.max(initial=0.0)) + 1e-300


def _tiles(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Cuts ordered sizes into tiles of ``_RIGHT`` rows at most; long runs of one size are tiles of their own."""
    ends = [*(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
    out, start, at = [], 0, 0  # at: the end of the runs so far
    for end in ends:
        if end - at >= _RIGHT // 16:
            out.append((start, at))
            start = at
        while end - start > _RIGHT:
            out.append((start, start + _RIGHT))
            start += _RIGHT
        if end - at >= _RIGHT // 16:
            out.append((start, end))
            start = end
        at = end
    return [(s, e) for s, e in [*out, (start, len(sizes))] if e > s]


def nearest_ward(L: np.ndarray, ln: np.ndarray, R: np.ndarray, rn: np.ndarray, rid: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each left centroid (of ``ln`` rows) the place of the right one at the least Ward distance
    sqrt(2 na nb / (na + nb)) |a - b| and that distance; ties to the smaller ``rid``; -1 without any.  ``own``: the
    place of the left one among the right ones, which it is not compared with, or -1.

    A matrix product finds the few that rounding leaves; those are measured by direct differences."""
    nn, dist = np.full(len(L), -1), np.full(len(L), np.inf)
    if not len(R):
        return nn, dist
    order = np.lexsort((rid, rn))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own, R, rn, rid = np.where(own >= 0, rank[own], -1), R[order], rn[order].astype(float), rid[order]
    a, b, error = _products(L, R)
    tiles = _tiles(rn)
    for s in range(0, len(L), _LEFT):
        na, me = ln[s:s + _LEFT].astype(float), own[s:s + _LEFT]
        best, found = np.full(len(na), np.inf), []

        def candidates(x, y, err, low, high):
            """Pairs (left, right) with the tile [low, high) that may be the nearest."""
            S = x @ y.T
            at = np.flatnonzero((me >= low) & (me < high))
            S[at, me[at] - low] = np.inf
            top = na * rn[high - 1] / (na + rn[high - 1])  # the greatest factor, or the only one
            one = rn[low] == rn[high - 1]
            if not one:
                S *= ((na[:, None] * rn[None, low:high]) / (na[:, None] + rn[None, low:high])).astype(S.dtype)
            np.minimum(best, S.min(axis=1) * (top if one else 1.0) + err * top, out=best)
            cut = (best + err * top) / (top if one else 1.0)
            cut = (cut + 1e-6 * np.abs(cut)).astype(S.dtype)  # products and cuts are rounded
            r, c = places(S <= np.nextafter(cut, np.inf, dtype=S.dtype)[:, None])
            fin = np.isfinite(S[r, c])
            return r[fin], c[fin]

        for low, high in tiles:
            r, c = candidates(a[s:s + _LEFT], b[low:high], error[s:s + _LEFT], low, high)
            if len(r) > 16 * len(na) and a.dtype != np.float64:  # close rows, far from the middle
                r, c = candidates(*_products(L[s:s + _LEFT], R[low:high], np.float64), low, high)
            c += low
            for k in range(0, len(r), _MEASURED):
                i, j = r[k:k + _MEASURED], c[k:k + _MEASURED]
                d = np.sqrt(2.0 * na[i] * rn[j] / (na[i] + rn[j])) * exact_distance(L[s:s + _LEFT][i], R[j])
                w = least_of_rows(i, d, rid[j])
                found.append((i[w], j[w], d[w]))
        if found:
            r, c, d = (np.concatenate(x) for x in zip(*found))
            w = least_of_rows(r, d, rid[c])
            nn[s + r[w]], dist[s + r[w]] = order[c[w]], d[w]
    return nn, dist


def knn(left: DataFrame, right: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
        exclude_self: bool = True, block_rows: int | None = None, right_tag: str | None = None) -> DataFrame:
    """The ``k`` nearest right rows of every left row: ``(id, nbr, tag, dist, rank)``.

    Ties on distance are broken by the smaller neighbour id.  Each block pair
    keeps its k best per left row; a final ``row_number <= k`` over at most
    k × blocks candidates per row picks the global k.
    """
    inp = _pairs_input(left, right, id_col, vec_col, None, right_tag, block_rows)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lft, rgt, L, R = _split(pdf)
        if len(lft) == 0 or len(rgt) == 0:
            return pd.DataFrame({"id": [], "nbr": [], "tag": [], "dist": []})
        lid, rid, rtag = lft["id"].to_numpy(), rgt["id"].to_numpy(), rgt["tag"].to_numpy()
        outs, step = [], chunk_rows(len(R))
        for s in range(0, len(L), step):
            ids = lid[s:s + step]
            S, err = squared(L[s:s + step], R)
            if exclude_self:
                S[ids[:, None] == rid[None, :]] = np.inf
            kk = min(k, len(rid))
            r, c = places(S <= row_cut(S, kk) + 2 * err)
            fin = np.isfinite(S[r, c])
            r, c = r[fin], c[fin]
            d = exact_distance(L[s:s + step][r], R[c])
            w = least_of_rows(r, d, rid[c], k)
            outs.append(pd.DataFrame({"id": ids[r[w]], "nbr": rid[c[w]], "tag": rtag[c[w]], "dist": d[w]}))
        return pd.concat(outs, ignore_index=True)

    cand = inp.groupBy("bl", "br").applyInPandas(kernel, "id long, nbr long, tag long, dist double")
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def same_rows(ids: np.ndarray, order: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of equal ids; ``ordered``: the right ids in the order ``order``."""
    a, b = np.searchsorted(ordered, ids), np.searchsorted(ordered, ids, "right")
    r = np.repeat(np.arange(len(ids)), b - a)
    return r, order[np.arange(len(r)) + np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a)]


def _label_sums(L: np.ndarray, lid: np.ndarray, R: np.ndarray, rid: np.ndarray, rc: np.ndarray):
    """The labels of the right rows, and for some left rows at a time (from which on, Σ distance to each
    label's rows, how many those are; the row itself excluded)."""
    by_label = np.argsort(rc, kind="stable")
    R, rid, rc = R[by_label], rid[by_label], rc[by_label]
    labels, starts, of, size = np.unique(rc, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(rid)
    ordered, step = rid[order], chunk_rows(len(R))

    def chunks():
        for s in range(0, len(L), step):
            D, err = squared(L[s:s + step], R)
            near = places(D < 1e6 * err)  # where rounding would show
            np.sqrt(np.maximum(D, 0.0, out=D), out=D)
            D[near] = exact_distance(L[s:s + step][near[0]], R[near[1]])
            r, c = same_rows(lid[s:s + step], order, ordered)
            D[r, c] = 0.0
            cnt = np.tile(size, (len(D), 1))
            np.subtract.at(cnt, (r, of[c]), 1)
            yield s, np.add.reduceat(D, starts, axis=1), cnt
    return labels, chunks()


def cluster_distance_sums(df: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                          cluster_col: str = "cluster_id", block_rows: int | None = None) -> DataFrame:
    """For every row and every cluster: Σ distance and count to that cluster's rows
    (the row itself excluded).  Output ``(id, cluster, sum_dist, cnt)``."""
    inp = _pairs_input(df, df, id_col, vec_col, None, cluster_col, block_rows)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lft, rgt, L, R = _split(pdf)
        outs = [pd.DataFrame({"id": [], "cluster": [], "sum_dist": [], "cnt": []})]
        if len(lft) and len(rgt):
            lid = lft["id"].to_numpy()
            labels, chunks = _label_sums(L, lid, R, rgt["id"].to_numpy(), rgt["tag"].to_numpy())
            for s, sums, cnt in chunks:
                outs.append(pd.DataFrame({
                    "id": np.repeat(lid[s:s + len(sums)], len(labels)), "cluster": np.tile(labels, len(sums)),
                    "sum_dist": sums.reshape(-1), "cnt": cnt.reshape(-1)}))
        return pd.concat(outs, ignore_index=True)

    part = inp.groupBy("bl", "br").applyInPandas(kernel, "id long, cluster long, sum_dist double, cnt long")
    return part.groupBy("id", "cluster").agg(F.sum("sum_dist").alias("sum_dist"), F.sum("cnt").alias("cnt"))


def _cluster_means(d: DataFrame, id_col: str, vec_col: str, cluster_col: str, block_rows: int | None) -> DataFrame:
    """What a row's silhouette needs: (id, cluster, sum_dist, cnt) of its own cluster and of some others, and
    (id, null, ..., best) the least mean distance to the rest of them.

    Right blocks are cut from the rows in the order of their cluster, so all clusters of a block but its first
    and last are whole there; of those only the least mean is kept.  What is dealt on does not grow with
    the number of clusters.  Rows of one id are taken together, as one left block has them all."""
    n, width = extent(d, vec_col)
    block_rows = block_rows or block_size(n, width)
    blocks = max(1, math.ceil(n / block_rows))
    rows = dense_positions(d.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(cluster_col).cast("long").alias("c")), F.col("c"), F.col("id"))
    inp = _tagged(rows.filter("id is not null"), "id", "v", "c", blocks, blocks, 0).unionByName(
        _tagged(rows, "id", "v", "c", blocks, blocks, 1, F.floor(F.col("pos") / block_rows)))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lft, rgt, L, R = _split(pdf)
        outs = [pd.DataFrame({"id": [], "cluster": [], "sum_dist": [], "cnt": [], "best": []})]
        if len(lft) == 0 or len(rgt) == 0:
            return outs[0]
        by_id = np.argsort(lft["id"].to_numpy(), kind="stable")
        L, lid, lc = L[by_id], lft["id"].to_numpy()[by_id], lft["tag"].to_numpy()[by_id]
        labels, chunks = _label_sums(L, lid, R, rgt["id"].to_numpy(), rgt["tag"].to_numpy())
        whole = np.ones(len(labels), bool)
        whole[[0, -1]] = False

        def out(ids, sums, cnt, own, low, high):
            mine = own > 0
            take = whole & (cnt > 0) & (~mine | (low != high)[:, None])  # an id in several clusters is another one to each
            mean = np.divide(sums, cnt, out=np.full(sums.shape, np.nan), where=take)
            has = take.any(axis=1)
            r, c = np.nonzero(mine | ~whole)
            outs.append(pd.DataFrame({"id": ids[r], "cluster": labels[c], "sum_dist": sums[r, c], "cnt": cnt[r, c], "best": np.nan}).astype({"cluster": "Int64", "cnt": "Int64"}))
            outs.append(pd.DataFrame({"id": ids[has], "cluster": None, "sum_dist": np.nan, "cnt": None, "best": np.fmin.reduce(mean[has], axis=1)}).astype({"cluster": "Int64", "cnt": "Int64"}))

        held = None  # the last id so far, which the next rows may have too
        for s, sums, cnt in chunks:
            own = lc[s:s + len(sums)]
            got = (lid[s:s + len(sums)], sums, cnt, (own[:, None] == labels[None, :]).astype(np.int64), own, own)
            if held is not None:
                got = tuple(np.concatenate(x) for x in zip(held, got))
            ids, at = np.unique(got[0], return_index=True)
            one = (ids, *(np.add.reduceat(x, at, axis=0) for x in got[1:4]), np.minimum.reduceat(got[4], at), np.maximum.reduceat(got[5], at))
            out(*(x[:-1] for x in one))
            held = tuple(x[-1:] for x in one)
        out(*held)
        return pd.concat(outs[1:], ignore_index=True)

    part = inp.groupBy("bl", "br").applyInPandas(kernel, "id long, cluster long, sum_dist double, cnt long, best double")
    return part.groupBy("id", "cluster").agg(F.sum("sum_dist").alias("sum_dist"), F.sum("cnt").alias("cnt"), F.min("best").alias("best"))


def silhouette_rows(df: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                    cluster_col: str = "cluster_id", block_rows: int | None = None) -> DataFrame:
    """Per-row silhouette (Euclidean) over non-noise rows: singleton → 0, a = b = 0 (copies
    in several clusters) → 0, a = mean distance to own cluster, b = least mean to another."""
    d = df.filter(F.col(cluster_col) != -1)
    sums = _cluster_means(d, id_col, vec_col, cluster_col, block_rows)
    own = d.select(F.col(id_col).cast("long").alias("id"), F.col(cluster_col).cast("long").alias("own"))
    j = sums.join(own, "id").withColumn("mean", F.try_divide("sum_dist", "cnt"))
    g = j.groupBy("id").agg(
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("mean"))).alias("a"),
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("cnt"))).alias("own_others"),
        F.min(F.when(F.col("cluster").isNull(), F.col("best"))
               .when((F.col("cluster") != F.col("own")) & (F.col("cnt") > 0), F.col("mean"))).alias("b"),
        F.first("own").alias("own"))
    s = F.when(F.coalesce(F.col("own_others"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return g.select("id", "own", "a", "b", s.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str = "id", vec_col: str = "embedding",
               cluster_col: str = "cluster_id", block_rows: int | None = None) -> DataFrame:
    """Mean silhouette over non-noise rows; null unless there are ≥ 2 clusters."""
    rows = silhouette_rows(df, id_col, vec_col, cluster_col, block_rows)
    return rows.agg(F.avg("silhouette").alias("s"), F.countDistinct("own").alias("k")).select(
        F.when(F.col("k") > 1, F.col("s")).alias("silhouette"))


def silhouette_fast(df: DataFrame, vec_col: str = "embedding", cluster_col: str = "cluster_id") -> DataFrame:
    """A12 (fast=True): MLlib's evaluator, which uses squared Euclidean distance."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    d = df.filter(F.col(cluster_col) != -1).select(
        array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"),
        F.col(cluster_col).cast("double").alias("prediction"))
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction", distanceMeasure="squaredEuclidean")
    return df.sparkSession.createDataFrame([(float(ev.evaluate(d)),)], "silhouette_fast double")


def similar_pairs(df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding",
                  block_rows: int | None = None) -> DataFrame:
    """All pairs (a < b) with cosine similarity ≥ threshold: ``(a, b, cosine)``."""
    inp = _own_pairs_input(df, id_col, vec_col, block_rows)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lft, rgt, L, R = _split(pdf)
        own = bool(pdf["bl"].iloc[0] == pdf["br"].iloc[0])
        if own:
            rgt, R = lft, L
        if len(lft) == 0 or len(rgt) == 0:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        lid, rid = lft["id"].to_numpy(), rgt["id"].to_numpy()
        ln = np.linalg.norm(L, axis=1)
        rn = np.linalg.norm(R, axis=1)
        outs, step = [], chunk_rows(len(R))
        for s in range(0, len(L), step):
            Lc = L[s:s + step]
            den = ln[s:s + step, None] * rn[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                C = np.where(den > 0, (Lc @ R.T) / den, 0.0)
            r, c = places(C >= threshold)
            a, b, cosine = lid[s:s + step][r], rid[c], C[r, c]
            keep = a < b if own else (a < b) | (a > b)
            a, b = a[keep], b[keep]
            outs.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": cosine[keep]}))
        return pd.concat(outs, ignore_index=True)

    return inp.groupBy("bl", "br").applyInPandas(kernel, "a long, b long, cosine double")


def nearest_centroid(df: DataFrame, cents: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                     cent_id: str = "cluster_id", cent_vec: str = "centroid", metric: str = "l2",
                     exclude_col: str | None = None, block_rows: int | None = None) -> DataFrame:
    """Best centroid per row — least L2 distance or greatest cosine — ``(id, best, score)``.

    Blocks of rows meet blocks of centroids; each pair of blocks gives one
    candidate per row.  ``exclude_col`` skips the row's own cluster.  Ties go to
    the smaller cluster id; the cosine of a zero vector is 0.
    """
    left = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"),
                     (F.col(exclude_col) if exclude_col else F.lit(None)).cast("long").alias("own"))
    right = cents.select(F.col(cent_id).alias("id"), F.col(cent_vec).alias("v"))
    inp = _pairs_input(left, right, "id", "v", "own", None, block_rows)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lft, rgt, L, R = _split(pdf)
        if len(lft) == 0 or len(rgt) == 0:
            return pd.DataFrame({"id": [], "best": [], "cost": []})
        order = np.argsort(rgt["id"].to_numpy())
        rid, R = rgt["id"].to_numpy()[order], R[order]
        lid, own = lft["id"].to_numpy(), lft["tag"].to_numpy()
        outs = []
        for s, D in _dist_chunks(L, R):
            if metric != "l2":
                den = np.linalg.norm(L[s:s + len(D)], axis=1)[:, None] * np.linalg.norm(R, axis=1)[None, :]
                D = -np.divide(L[s:s + len(D)] @ R.T, den, out=np.zeros_like(D), where=den > 0)
            if exclude_col:
                D = np.where(own[s:s + len(D), None] == rid[None, :], np.inf, D)
            j = D.argmin(axis=1)
            best = D[np.arange(len(D)), j]
            ok = np.isfinite(best)
            outs.append(pd.DataFrame({"id": lid[s:s + len(D)][ok], "best": rid[j][ok], "cost": best[ok]}))
        return pd.concat(outs, ignore_index=True)

    cand = inp.groupBy("bl", "br").applyInPandas(kernel, "id long, best long, cost double")
    g = cand.groupBy("id").agg(F.min_by("best", F.struct("cost", "best")).alias("best"), F.min("cost").alias("cost"))
    return g.select("id", "best", (F.col("cost") if metric == "l2" else -F.col("cost")).alias("score"))


def worst_ratio(clusters: DataFrame, id_col: str, vec_col: str, spread_col: str, block_rows: int | None = None) -> DataFrame:
    """A11's inner step, ``(id, r)``: per cluster the greatest (S_i + S_j) / d(c_i, c_j); 0 for equal centroids."""
    side = clusters.select(F.col(id_col).alias("id"), F.array_append(vec_col, F.col(spread_col)).alias("v"))
    inp = _pairs_input(side, side, "id", "v", None, None, block_rows)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lft, rgt, L, R = _split(pdf)
        if len(lft) == 0 or len(rgt) == 0:
            return pd.DataFrame({"id": [], "r": []})
        lid, rid = lft["id"].to_numpy(), rgt["id"].to_numpy()
        outs = []
        for s, D in _dist_chunks(L[:, :-1], R[:, :-1]):
            sums = L[s:s + len(D), -1][:, None] + R[:, -1][None, :]
            ratio = np.divide(sums, D, out=np.zeros_like(D), where=D > 0)
            ratio = np.where(lid[s:s + len(D), None] == rid[None, :], -np.inf, ratio)
            outs.append(pd.DataFrame({"id": lid[s:s + len(D)], "r": ratio.max(axis=1)}))
        out = pd.concat(outs, ignore_index=True)
        return out[np.isfinite(out["r"])]

    return inp.groupBy("bl", "br").applyInPandas(kernel, "id long, r double").groupBy("id").agg(F.max("r").alias("r"))
