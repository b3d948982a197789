"""Benchmark decontamination with an FM-index per shard of the training documents.

A shard is a task's documents up to ``4 * SHARD`` words (or one longer document); documents are never
split. Words become numbers of the benchmark's vocabulary. Runs of such words
that are too short for any window cannot hold one and are left out of the
index; what remains is suffix-sorted, its Burrows-Wheeler transform goes into a
wavelet matrix, and all windows are searched backward at once. Occurrences are
located by walking to sampled suffix positions; overlapping ones are merged
into removal spans.

The benchmark reaches the tasks in blocks of at most ``block_bytes`` (its size
is measured first): one block for any usual benchmark, else one pass for each
block, whose spans are merged per document.

Edge cases: null and empty texts have no words and are clean; items without
words have no window; items of fewer words than a window are one window;
repeated items and items with equal windows all count for a document; a null
item_id counts as the item "null". Rows with equal doc_id are judged on their
own. Empty tables: no documents, no rows; no benchmark, nothing is hit. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cover, materialize, plain, prepare, restored, runs_of, texts_of

WINDOW, SHARD, STEP = 13, 1 << 18, 16
#: ASCII other than digits and letters separates words; capitals become small.
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Phrases:
    """A block of the benchmark: numbered words, distinct windows and whose they are."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners[tuple(w[i:i + window])].add(item)
        by_length = defaultdict(list)
        for p in owners:
            by_length[len(p)].append(p)
        self.patterns = {n: np.array(ps, np.int64) for n, ps in sorted(by_length.items())}
        self.owners = {n: [sorted(owners[p]) for p in ps] for n, ps in sorted(by_length.items())}
        self.shortest = min(by_length, default=0)


class Index:
    """FM-index of numbered words; 0 separates the runs."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        sep = text == 0
        # separators are told apart by their place, so no comparison passes one
        rank = np.where(sep, np.cumsum(sep) - 1, text + sep.sum()).astype(np.int64)
        k = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:n - k] = rank[k:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key)
            s = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
            rank, k = new, 2 * k
            if rank.max() == n - 1 or k >= n:
                break
        suffixes = np.argsort(rank)
        before = text[suffixes - 1]
        before[suffixes == 0] = 0
        self.n, self.bwt = n, before
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))))
        starts = np.concatenate(([True], sep[:-1]))
        self.sampled = np.where((suffixes % STEP == 0) | starts[suffixes], suffixes, -1)
        self.levels = []
        for bit in range(int(before.max()).bit_length() - 1, -1, -1):
            b = (before >> bit) & 1
            ones = np.concatenate(([0], np.cumsum(b, dtype=np.int32)))
            self.levels.append((bit, ones, n - int(ones[-1])))
            before = np.concatenate((before[b == 0], before[b == 1]))
        self.top = 1 << len(self.levels)

    def ranks(self, c: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol c is in the transform before each place."""
        p = [np.zeros(len(c), np.int64), *places]
        for bit, ones, zeros in self.levels:
            up = ((c >> bit) & 1).astype(bool)
            p = [np.where(up, zeros + ones[x], x - ones[x]) for x in p]
        return [np.where(c < self.top, x - p[0], 0) for x in p[1:]]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence of equally long patterns."""
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            known = c < len(self.first) - 1
            live, lo, hi, c = live[known], lo[known], hi[known], c[known]
            lo, hi = (self.first[c] + r for r in self.ranks(c, lo, hi))
            alive = lo < hi
            live, lo, hi = live[alive], lo[alive], hi[alive]
            if not len(live):
                break
        count = hi - lo
        row = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(live) else np.empty(0, np.int64)
        return np.repeat(live, count), self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, todo, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            at = self.sampled[row]
            found = at >= 0
            out[todo[found]] = at[found] + steps
            todo, row = todo[~found], row[~found]
            c = self.bwt[row]
            row = self.first[c] + self.ranks(c, row)[0] if len(row) else row
            steps += 1
        return out


def shard_hits(texts: list[np.ndarray], phrases: Phrases) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
    """Numbered documents -> for each one that is hit: removal spans (word numbers) and item ids."""
    pieces, doc, word = [], [], []
    for d, w in enumerate(texts):
        for s, e in zip(*runs_of(w > 0)):
            if e - s >= phrases.shortest:
                pieces.append(w[s:e]), pieces.append(np.zeros(1, np.int64))
                doc.append(np.full(e - s + 1, d)), word.append(np.arange(s, e + 1))
    if not pieces:
        return {}
    index, doc, word = Index(np.concatenate(pieces)), np.concatenate(doc), np.concatenate(word)
    starts, ends, items = defaultdict(list), defaultdict(list), defaultdict(set)
    for n, patterns in phrases.patterns.items():
        which, at = index.search(patterns)
        for p, a in zip(which.tolist(), at.tolist()):
            d = int(doc[a])
            starts[d].append(int(word[a])), ends[d].append(n)
            items[d].update(phrases.owners[n][p])
    out = {}
    for d, s in starts.items():
        s, e = runs_of(cover(np.array(s), np.array(ends[d]), len(texts[d])))
        out[d] = list(zip(s.tolist(), e.tolist())), sorted(items[d])
    return out


_HITS = "n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def _hits(rows: DataFrame, phrases: Phrases, id_column: str, write: bool = False) -> DataFrame:
    """Hits of one block of phrases; written if ``write``, and then the block leaves the executors."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)
    kind = dict(rows.dtypes)[id_column]
    spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        ph = shared.value
        number = ph.vocabulary.get
        ids, lengths, texts, size = [], [], [], 0

        def out():
            hits = shard_hits(texts, ph)
            none = ([], [])
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([[{"s": s, "e": e} for s, e in hits.get(d, none)[0]] for d in range(len(ids))], spans_type),
                pa.array([hits.get(d, none)[1] for d in range(len(ids))], pa.list_(pa.string()))],
                [id_column, "n_words", "spans", "items"])
        for b in batches:
            for i, t in zip(b.column(id_column).to_pylist(), texts_of(b)):
                w = words_of(t)
                v = np.fromiter((number(x, 0) for x in w), np.int64, len(w))
                kept = v if ph.shortest and len(w) else np.empty(0, np.int64)
                ids.append(i), lengths.append(len(w)), texts.append(kept)
                size += len(kept)
                if size > 4 * SHARD:
                    yield out()
                    ids, lengths, texts, size = [], [], [], 0
        if ids:
            yield out()
    found = rows.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, {_HITS}")
    if write:
        found = materialize(found, "hits")
        shared.destroy()
    return found


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark's items, collected block by block of bounded size."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))
    size = b.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = max(1, -(-size * 2 // block_bytes))
    for k in range(n):
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield n, Phrases([(r.item, bytes(r.text or b"")) for r in part.collect()])


def hits(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", block_bytes: int = 16 << 20) -> DataFrame:
    """(id, n_words, n_hit, spans, items) of every row: hit words, merged spans [s, e) of word numbers, item ids."""
    prepare(docs.sparkSession)
    parts, rows = [], docs
    for n, phrases in _blocks(benchmark, block_bytes):
        if n > 1 and not parts:
            rows = materialize(docs.select(id_column, "text").withColumn("_rid", F.monotonically_increasing_id()), "rows")
        # of several blocks only one is held at a time
        parts.append(_hits(rows, phrases, id_column if n == 1 else "_rid", write=n > 1))
    found = parts[0]
    if len(parts) > 1:  # each document's spans of all blocks, joined
        for p in parts[1:]:
            found = found.unionByName(p)
        merged = F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), F.expr("cast(array() as array<struct<s:int,e:int>>)"), lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["e"] >= x["s"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e")))))
            .otherwise(F.concat(a, F.array(x))))
        found = (found.groupBy("_rid").agg(F.max("n_words").alias("n_words"), merged.alias("spans"),
                                           F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
                 .join(rows.select("_rid", id_column), "_rid").drop("_rid"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(id_column, "n_words", n_hit.alias("n_hit"), "spans", F.array_sort("items").alias("items"))


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    h = hits(docs, benchmark)
    return h.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    rows = materialize(plain(docs).withColumn("_rid", F.monotonically_increasing_id()), "rows")
    bad = hits(rows, benchmark, "_rid").filter(is_contaminated()).select("_rid")
    return restored(rows.join(bad, "_rid", "left_anti"), docs)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_SQL_WORDS} AS ws FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
occ AS MATERIALIZED (SELECT s.doc_id, s.i, s.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM starts) s JOIN win ON s.n = win.n AND s.w = win.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), FALSE) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
