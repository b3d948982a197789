"""SimHash near-duplicate detection by anchor-point covering.

Fingerprints are 64 bits. Two fingerprints within ``3`` bits differ by at most
one bit in one of their 32-bit halves, so each half gets a covering code of its
own: the perfect Hamming code of length 31 (the half's top bit is left out),
covering radius 1. A half within one bit of another lies within radius +
threshold = 2 of the other's nearest anchor, so each fingerprint is replicated
to every anchor within 2 (one or sixteen of 2**26), and compared per anchor.

Anchor groups are compared breadth first: each fingerprint reached takes the
still unreached ones within the threshold. That finds the same connected
groups as all pairs would, emits fewer links than members, and needs little
more than one pass over a dense group. Groups of over ``group_rows`` are cut
into blocks; every pair of blocks is a task of its own.

Edge cases: null and empty texts have no words and fingerprint zero, linked
like any other; texts of fewer words than a shingle are one shingle; rows with
equal doc_id are separate rows; a null doc_id is never the smallest (a group of
null ids alone has a null component). An empty table gives an empty result.
Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, plain, prepare, restored, texts_of
from .links import components

MAX_BITS, SHINGLE, SEED, PIECE = 3, 3, 42, 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64-bit majority vote of the XXH64 of the text's word shingles."""
    w = text.lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    n = max(1, len(w) - words + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        votes += np.unpackbits(h[i:i + PIECE].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n).view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_column: str = "doc_id") -> DataFrame:
    """(id, text) -> (id, fp long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t, words) for t in texts_of(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(id_column), fp], [id_column, "fp"])
    return docs.select(id_column, "text").mapInArrow(run, f"{id_column} long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for i in range(31):
        s ^= np.where((x >> i) & 1, i + 1, 0)
    return s


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor key (half, codeword) and home flag (the nearest anchor) of every replica."""
    rows, keys, home = [], [], []
    idx = np.arange(len(fp))
    for half in (0, 1):
        x = ((fp >> (32 * half)) & 0x7FFFFFFF).astype(np.int64)
        s = _syndrome(x)
        near = np.where(s > 0, x ^ (np.int64(1) << np.maximum(s - 1, 0)), x)
        rows.append(idx), keys.append(near | (half << 31)), home.append(np.ones(len(fp), bool))
        for i in range(1, 32):
            j = s ^ i  # the other bit that leads to a codeword at distance 2
            ok = (s > 0) & (j > i)
            far = x[ok] ^ (np.int64(1) << (i - 1)) ^ (np.int64(1) << (j[ok] - 1))
            rows.append(idx[ok]), keys.append(far | (half << 31)), home.append(np.zeros(len(far), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def reach(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (each member of a group to the group's first) of the linked groups in ``fp``."""
    left, a, b = fp.astype(np.uint64), [], []
    while len(left) > 1:
        first, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            x, front = front[0], front[1:]
            hit = np.bitwise_count(left ^ x) <= bits
            if hit.any():
                new, left = left[hit], left[~hit]
                a.append(np.full(len(new), first)), b.append(new)
                front = np.concatenate((front, new))
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def links(nodes: DataFrame, bits: int = MAX_BITS, group_rows: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect what is within ``bits``."""
    if not 0 <= bits <= 3:
        raise ValueError("the anchors of this covering serve thresholds of 0 to 3 bits")
    spark = nodes.sparkSession

    def replicate(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            row, key, home = anchors_of(fp)
            for i in range(0, len(row), 1 << 16):
                j = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_pydict({"anchor": key[j], "fp": fp[row[j]], "home": home[j]})

    placed = nodes.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean").repartition(partitions(spark), "anchor")
    size = (placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home"))
            .filter("n > 1 and home").select("anchor", "n"))
    held = placed.join(size.hint("shuffle_hash"), "anchor")
    # a group of over group_rows is cut into blocks; a task takes one pair of blocks
    k = F.ceil(F.col("n") / group_rows).cast("int")
    block = F.pmod(F.xxhash64("fp"), k).cast("int")
    held = held.select("anchor", "fp", F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(
        F.least(o, block).alias("p"), F.greatest(o, block).alias("q")))).alias("x"))
    held = held.select("fp", "anchor", "x.p", "x.q").repartition(partitions(spark), "anchor", "p", "q").sortWithinPartitions("anchor", "p", "q")

    def compare(batches):
        keep = None
        def out(fp):
            u, v = reach(fp, bits)
            return pa.RecordBatch.from_pydict({"u": u, "v": v})
        for b in batches:
            t = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("anchor", "p", "q", "fp")])
            t = t if keep is None else np.concatenate((keep, t), axis=1)
            cut = np.flatnonzero((t[:3, 1:] != t[:3, :-1]).any(axis=0)) + 1
            cut = np.concatenate(([0], cut))
            for i, j in zip(cut[:-1], cut[1:]):
                if j - i > 1:
                    yield out(t[3, i:j])
            keep = t[:, cut[-1]:]
        if keep is not None and keep.shape[1] > 1:
            yield out(keep[3])

    return held.mapInArrow(compare, "u long, v long").distinct()


def _grouped(fps: DataFrame, id_column: str, bits: int) -> DataFrame:
    """(id, fp) -> (fp, component_id): the smallest id reachable from a fingerprint."""
    nodes = materialize(fps.groupBy("fp").agg(F.min(id_column).alias("first")), "nodes")
    comp = components(links(nodes, bits))
    roots = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return roots.join(least, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, words: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id) of every row of ``docs``."""
    prepare(docs.sparkSession)
    fps = materialize(fingerprints(docs, words), "fingerprints")
    return fps.join(_grouped(fps, "doc_id", bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that with the smallest doc_id.

    Of rows with that doc_id the first stored stays; a group without any
    doc_id keeps its first stored row. The columns are those of ``docs``.
    """
    prepare(docs.sparkSession)
    rows = materialize(plain(docs).withColumn("_rid", F.monotonically_increasing_id()), "rows")
    fps = materialize(fingerprints(rows, words, "_rid"), "fingerprints")
    by_fp = _grouped(fps, "_rid", bits)
    keep = (fps.join(by_fp, "fp").join(rows.select("_rid", "doc_id"), "_rid").groupBy("component_id")
            .agg(F.min_by("_rid", F.struct(F.col("doc_id").isNull(), "doc_id", "_rid")).alias("_rid")).select("_rid"))
    return restored(rows.join(keep, "_rid", "left_semi"), docs)
