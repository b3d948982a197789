"""Exact substring deduplication by merged sorted suffixes.

Goes: each byte covered by a string of ``WINDOW`` bytes that also starts anywhere
else, in this document or another. Matches never cross documents and are judged
on the input.

Only texts that can match are sorted. Every window has a sampled gram, the one
with the least hash of its ``GRAM``-byte strings; equal windows have equal
samples at equal places. Neighbouring windows with the same sample form a unit;
units whose gram is nowhere else cannot match. Equal units, found by
digest, are repeated as they are, and one of them stands for all. Unequal units of
one gram are what the sorted suffixes decide:

* A task takes the units of whole grams, in shards of ``SHARD`` bytes. A text's
  symbols are its strings of ``SYMBOL`` bytes, ordered by hash; the place after
  a symbol is ``SYMBOL`` bytes on. Each shard's suffixes are sorted by doubling.
* The shards are merged by refining their interleave: after round k, rows of
  all shards are in blocks by their first k symbols; the next round's blocks
  come from a row's symbol and the block of the suffix after it, which runs
  along each shard's order, so the shards' sorted key lists are merged and
  nothing is sorted anew. The blocks left after WINDOW / SYMBOL rounds are the
  repeated intervals; no common prefixes are kept, no preceding symbols built.
* A gram whose units hold over ``HOT`` bytes is too much for one task: its
  windows are counted by their 128-bit digests instead, dealt by digest.

Equal texts are found first; they go whole (if long enough), and one of them is
searched for the others' sake. Equal units of one task are settled there, so a
passage of a third of all documents sends a row for each task.

Edge cases: null counts as empty; texts of fewer bytes than the window lose
nothing; cuts may fall inside a character, so the rest is binary (``kept``);
rows with equal doc_id are separate documents; very long texts are searched in
overlapping pieces. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cover, keyed_table, materialize, partitions, plain, prepare, runs_of, texts_of
from .substrings import samples

WINDOW, GRAM, SYMBOL = 200, 100, 50
PIECE, SHARD, GROUP, HOT, FLUSH = 1 << 20, 1 << 19, 1 << 21, 8 << 20, 1 << 17
_B, _M = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(a: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n bytes from each place on, joined from hashes of powers of two."""
    if len(a) < n:
        return np.empty(0, np.uint64)
    powers = [((a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), _B)]
    while 2 << (len(powers) - 1) <= n:
        h, b = powers[-1]
        s = 1 << (len(powers) - 1)
        powers.append((h[:-s] * b + h[s:], np.multiply(b, b)))
    out, have = None, 0
    for k in range(len(powers) - 1, -1, -1):
        s, (h, b) = 1 << k, powers[k]
        if n - have >= s:
            m = len(a) - have - s + 1
            out = h if out is None else out[:m] * b + h[have:have + m]
            have += s
    out = (out ^ (out >> np.uint64(32))) * _M
    return out ^ (out >> np.uint64(29))


def units_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first window and number of windows of each unit."""
    parts, a = [], np.frombuffer(text, np.uint8)
    for i in range(0, len(a) - WINDOW + 1, PIECE):
        h = grams(a[i:i + PIECE + WINDOW - 1], GRAM)
        p = samples(h, WINDOW - GRAM + 1)
        s = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        parts.append((h[p[s]].view(np.int64), s + i, np.diff(np.append(s, len(p)))))
    return tuple(map(np.concatenate, zip(*parts)))


def _units(docs: DataFrame) -> DataFrame:
    """(rid, text, w) -> (h, d, rid, s, n, w, settled, stands).

    settled: the unit is repeated among the task's documents, or its text is;
    stands: the first of the task's equal units, which goes to the gram's group.
    """
    def run(batches):
        parts, size = [], 0
        for b in batches:
            for rid, w, t in zip(b.column("rid").to_pylist(), b.column("w").to_pylist(), texts_of(b)):
                if len(t) < WINDOW:
                    continue
                h, s, n = units_of(t)
                d = np.fromiter((xxhash.xxh3_64_intdigest(t[x:y]) for x, y in zip(s.tolist(), (s + n + WINDOW - 1).tolist())), np.uint64, len(s)).view(np.int64)
                parts.append((h, d, np.full(len(s), rid), s, n, np.full(len(s), w)))
                size += len(s)
                if size > FLUSH:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    def flush(parts):
        h, d, rid, s, n, w = map(np.concatenate, zip(*parts))
        order = np.lexsort((d, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])))
        group = np.cumsum(new) - 1
        weight = np.bincount(group, weights=w[order])
        total, stands = np.empty(len(h), np.int64), np.empty(len(h), bool)
        total[order], stands[order] = np.minimum(weight, 2)[group], new
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, d, rid, s.astype(np.int32), n.astype(np.int32), total.astype(np.int32), total > 1, stands)],
                                          ["h", "d", "rid", "s", "n", "w", "settled", "stands"])
    return docs.select("rid", "text", "w").mapInArrow(run, "h long, d long, rid long, s int, n int, w int, settled boolean, stands boolean")


def _segments(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, units: s, n, h, w) -> (h, rid, s, n, w, seg): the units' bytes."""
    def run(batches):
        for b in batches:
            cols, size = [[] for _ in range(6)], 0
            for rid, t, units in zip(b.column("rid").to_pylist(), texts_of(b), b.column("units").to_pylist()):
                for u in units:
                    for c, v in zip(cols, (u["h"], rid, u["s"], u["n"], u["w"], t[u["s"]:u["s"] + u["n"] + WINDOW - 1])):
                        c.append(v)
                    size += u["n"] + WINDOW
                if size > 1 << 22:
                    yield _segment_batch(cols)
                    cols, size = [[] for _ in range(6)], 0
            yield _segment_batch(cols)
    return rows.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "units").mapInArrow(
        run, "h long, rid long, s int, n int, w int, seg binary")


def _segment_batch(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
        pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["h", "rid", "s", "n", "w", "seg"])


class Shard:
    """The sorted suffixes of some segments, down to WINDOW bytes.

    row by row: symbol, the row of the suffix after it (-1: none), segment and place.
    """

    def __init__(self, segments: list[bytes], first: int):
        symbols, seg, place, after, at = [], [], [], [], 0
        for k, t in enumerate(segments):
            g = grams(np.frombuffer(t, np.uint8), SYMBOL)
            m = np.arange(len(g))
            symbols.append(g), seg.append(np.full(len(g), first + k)), place.append(m)
            after.append(np.where(m + SYMBOL < len(g), at + m + SYMBOL, -1))
            at += len(g)
        symbols, seg, place, after = map(np.concatenate, (symbols, seg, place, after))
        order = np.argsort(symbols)
        rank = np.empty(at, np.int64)
        s = symbols[order]
        rank[order] = np.cumsum(np.concatenate(([False], s[1:] != s[:-1]))) + 1
        step, jump = SYMBOL, after
        while step < WINDOW:  # doubling: by twice as many symbols
            key = rank * (at + 2) + np.where(jump >= 0, rank[jump], 0)
            order = np.argsort(key)
            k = key[order]
            rank[order] = np.cumsum(np.concatenate(([False], k[1:] != k[:-1]))) + 1
            jump = np.where(jump >= 0, jump[jump], -1)
            step *= 2
        row = np.empty(at, np.int64)
        row[order] = np.arange(at)
        nxt = after[order]
        self.symbol, self.seg, self.place = symbols[order], seg[order], place[order]
        self.after = np.where(nxt >= 0, row[nxt], -1)


def _merged(lists: list[np.ndarray]) -> np.ndarray:
    """Union of sorted lists (a stable sort merges presorted runs)."""
    x = np.concatenate(lists)
    x.sort(kind="stable")
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _placed(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Number of each key among all shards' keys; every list is sorted."""
    new = [np.concatenate(([True], k[1:] != k[:-1])) for k in keys]
    union = _merged([k[f] for k, f in zip(keys, new)])
    return [np.searchsorted(union, k[f])[np.cumsum(f) - 1] for k, f in zip(keys, new)]


def merge(shards: list[Shard]) -> list[np.ndarray]:
    """The rows' blocks after WINDOW / SYMBOL rounds: equal numbers, equal first WINDOW bytes."""
    symbols = _placed([s.symbol for s in shards])
    blocks = symbols  # the first round
    for _ in range(WINDOW // SYMBOL - 1):
        # 0: the text ends before; else the block of the suffix after the symbol
        tails = [np.where(s.after >= 0, b[s.after] + 1, 0) for s, b in zip(shards, blocks)]
        width = max(int(t.max()) for t in tails) + 1
        blocks = _placed([x * width + t for x, t in zip(symbols, tails)])
    return blocks


def repeated_starts(segments: list[bytes], counts: list[int], weights: list[int]) -> list[np.ndarray]:
    """For each segment, which of its windows occur more than once among all."""
    shards, i = [], 0
    while i < len(segments):
        j, size = i, 0
        while j < len(segments) and (j == i or size + len(segments[j]) <= SHARD):
            size += len(segments[j])
            j += 1
        shards.append(Shard(segments[i:j], i))
        i = j
    blocks = merge(shards)
    n, w = np.array(counts), np.array(weights)
    offset = np.concatenate(([0], np.cumsum(n)))
    total = np.zeros(max(int(b.max()) for b in blocks) + 1, np.int64)
    starts = [s.place < n[s.seg] for s in shards]  # those that begin a whole window
    for s, b, ok in zip(shards, blocks, starts):
        total += np.bincount(b[ok], weights=w[s.seg[ok]], minlength=len(total)).astype(np.int64)
    flags = np.zeros(offset[-1], bool)
    for s, b, ok in zip(shards, blocks, starts):
        flags[offset[s.seg[ok]] + s.place[ok]] = total[b[ok]] > 1
    return np.split(flags, offset[1:-1])


def _intervals(segments: DataFrame) -> DataFrame:
    """(h, rid, s, n, w, seg), a gram's units in one task -> (rid, s, e): removed spans."""
    def decide(group):
        flags = repeated_starts([g[4] for g in group], [g[2] for g in group], [g[3] for g in group])
        rid, s, e = [], [], []
        for (r, at, _, _, _), f in zip(group, flags):
            x, y = runs_of(f)
            rid += [r] * len(x)
            s += (x + at).tolist()
            e += (y + at + WINDOW - 1).tolist()
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["rid", "s", "e"])

    def run(batches):
        group, size, last = [], 0, None
        for b in batches:
            for h, *u in zip(*(b.column(c).to_pylist() for c in ("h", "rid", "s", "n", "w", "seg"))):
                if size > GROUP and h != last:
                    yield decide(group)
                    group, size = [], 0
                group.append(u)
                size += len(u[4])
                last = h
        if group:
            yield decide(group)
    n = partitions(segments.sparkSession)
    return segments.repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, "rid long, s int, e int")


def _hot_intervals(segments: DataFrame) -> DataFrame:
    """The same by counting the windows' digests, for grams too large for a task."""
    def run(batches):
        for b in batches:
            for rid, s, n, w, t in zip(*(b.column(c).to_pylist() for c in ("rid", "s", "n", "w", "seg"))):
                d = [xxhash.xxh3_128_intdigest(t[i:i + WINDOW]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array([x >> 64 for x in d], np.uint64).view(np.int64)), pa.array(np.array([x & (1 << 64) - 1 for x in d], np.uint64).view(np.int64)),
                    pa.array([rid] * n, pa.int64()), pa.array(range(s, s + n), pa.int32()), pa.array([w] * n, pa.int32())], ["d1", "d2", "rid", "s", "w"])
    windows = segments.mapInArrow(run, "d1 long, d2 long, rid long, s int, w int")
    many = windows.groupBy("d1", "d2").agg(F.sum("w").alias("c")).filter("c > 1").select("d1", "d2")
    return windows.join(many, ["d1", "d2"]).select("rid", "s", (F.col("s") + WINDOW).alias("e"))


def repeated_spans(rows: DataFrame, hot_bytes: int = HOT) -> DataFrame:
    """(rid, text, w) -> (rid, spans): [s, e) of the repeated bytes, unmerged."""
    n = partitions(rows.sparkSession)
    units = materialize(_units(rows).withColumn("uid", F.monotonically_increasing_id()), "units")
    dealt = units.filter("stands").repartition(n, "h")
    kinds = dealt.groupBy("h", "d").agg(F.sum("w").alias("c"), F.min("uid").alias("uid0"))
    each = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    state = kinds.join(each.hint("shuffle_hash"), "h").filter("c > 1 or kinds > 1")
    known = materialize(dealt.join(state.hint("shuffle_hash"), ["h", "d"]).select(
        "h", "rid", "s", "n", "settled", "c", (F.col("uid") == F.col("uid0")).alias("one"), "kinds"), "known_units")
    whole = (units.filter("settled").select("rid", "s", "n")
             .unionByName(known.filter("c > 1 and not settled").select("rid", "s", "n"))
             .select("rid", "s", (F.col("s") + F.col("n") + WINDOW - 1).alias("e")))
    wanted = (known.filter("one and kinds > 1").groupBy("rid")
              .agg(F.collect_list(F.struct("s", "n", "h", F.least("c", F.lit(2)).cast("int").alias("w"))).alias("units")))
    segments = materialize(_segments(rows, wanted), "segments")
    hot = materialize(segments.groupBy("h").agg(F.sum(F.length("seg")).alias("b")).filter(F.col("b") > hot_bytes).select("h"), "hot_grams")
    parts = whole.unionByName(_intervals(segments.join(hot, "h", "left_anti")))
    if not hot.isEmpty():
        parts = parts.unionByName(_hot_intervals(segments.join(hot, "h")))
    return parts.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def dedup_suffixes(docs: DataFrame, hot_bytes: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary) of every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    rows = keyed_table(plain(docs.select("doc_id", "text")), "suffix_docs")
    digests = rows.select("rid", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2")).filter("text is not null")
    least = digests.groupBy("d1", "d2").agg(F.min("rid").alias("low"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    copies = materialize(digests.join(least, ["d1", "d2"]).select("rid", (F.col("rid") == F.col("low")).alias("stands")), "copies")
    search = (rows.join(copies.hint("shuffle_hash"), "rid", "left").filter("stands is null or stands")
              .select("rid", "text", F.when(F.col("stands"), 2).otherwise(1).alias("w")))
    spans = repeated_spans(search, hot_bytes)

    def cut(batches):
        for b in batches:
            size, gone, runs, kept = [], [], [], []
            for t, at, copy in zip(texts_of(b), b.column("spans").to_pylist(), b.column("copy").to_pylist()):
                n = len(t)
                if copy:
                    flags = np.full(n, n >= WINDOW)
                elif at:
                    s = np.array([x["s"] for x in at])
                    flags = cover(s, np.array([x["e"] for x in at]) - s, n)
                else:
                    flags = np.zeros(n, bool)
                s, _ = runs_of(flags)
                size.append(n), gone.append(int(flags.sum())), runs.append(len(s))
                kept.append(np.frombuffer(t, np.uint8)[~flags].tobytes() if gone[-1] else t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, gone, runs)), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    every = (rows.join(spans.hint("shuffle_hash"), "rid", "left")
             .join(copies.select("rid", F.lit(True).alias("copy")).hint("shuffle_hash"), "rid", "left"))
    return every.select("doc_id", "text", "spans", "copy").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
