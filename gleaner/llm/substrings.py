"""Substring deduplication by level-wise doubling.

Goes: each word covered by a window of ``WINDOW`` words whose word sequence also
starts in a document with a smaller doc_id. Windows of ``FIRST`` words come
first; only what is repeated in another document is extended to twice the
length, and so on up to ``WINDOW`` (the last doubling is cut to it), until
nothing survives. At the first length each long window looks only at its
sampled short window, the one with the least hash: equal long windows have
equal samples, so none is missed.

A level is one pass over the texts that still have candidates, one shuffle of
narrow rows (hash, doc_id, row, place) and one group-by on the hash. A task
first compares its own documents: what another document of the task has too is
settled there, and only the rows of the smallest doc_id go to the hash's
group. A passage in a third of all documents so sends a few rows for each
task, and what is settled is spread by row. Of equal texts only that with the
smallest doc_id is searched; the others go whole.

Edge cases: null and empty texts have no words; a text of fewer than ``WINDOW``
words loses none; rows with equal doc_id don't remove words from one another;
a null doc_id is larger than any. Very long texts are whole. An empty table
gives an empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cover, keyed_table, materialize, partitions, plain, prepare, restored, texts_of

WINDOW, FIRST = 13, 7
BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FLUSH_ROWS, NO_ID = 1 << 18, (1 << 63) - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, n: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Hash of the n words from each place on."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    x = (h ^ (h >> np.uint64(31))) * base
    for j in range(n):
        out = out * base + x[j:len(h) - n + 1 + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def samples(short: np.ndarray, width: int) -> np.ndarray:
    """For each place: where in the ``width`` values from it on the least one is (the first of equals)."""
    place = np.arange(len(short))
    best, at, have = short, place, 1
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        right = best[step:step + m] < best[:m]
        at = np.where(right, at[step:step + m], at[:m])
        best = np.where(right, best[step:step + m], best[:m])
        have += step
    return at


def settle(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether its document is the smallest of those with its hash, whether there is another."""
    order = np.lexsort((doc, h))
    hs, ds = h[order], doc[order]
    new = np.concatenate(([True], hs[1:] != hs[:-1]))
    g = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    low, high = ds[starts][g], ds[np.append(starts[1:], len(hs)) - 1][g]
    least, more = np.empty(len(h), bool), np.empty(len(h), bool)
    least[order], more[order] = ds == low, low < high
    return least, more


def lengths(first: int = FIRST, window: int = WINDOW) -> list[int]:
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def chosen(x: np.ndarray, levels: list[int], *of: int) -> list[np.ndarray]:
    """For each long window: where the window of each level in ``of`` starts that stands for it.

    It holds the sample as near its middle as the long window allows, so equal
    long windows choose alike. The last level is the long window itself.
    """
    width = levels[-1] - levels[0] + 1
    sample = samples(window_hashes(x, levels[0]), width)
    start = np.arange(len(sample))
    return [np.clip(sample - (levels[k] - levels[0]) // 2, start, start + levels[-1] - levels[k]) for k in of]


def _rows(docs: DataFrame, k: int, levels: list[int]) -> DataFrame:
    """(rid, id, text[, places]) -> (h, h2, salt, id, rid, place, settled), a row for each window of level k.

    ``places`` are the surviving ones of the level before. Rows that need no
    group are salted by their row.
    """
    last = k == len(levels) - 1

    def run(batches):
        parts, size = [], 0
        for b in batches:
            places = b.column("places").to_pylist() if k else [None] * b.num_rows
            for rid, i, t, at in zip(b.column("rid").to_pylist(), b.column("id").to_pylist(), texts_of(b), places):
                w = t.split()
                if len(w) < levels[-1]:
                    continue
                x = word_hashes(w)
                if k:
                    before, now = chosen(x, levels, k - 1, k)
                    alive = np.zeros(len(w), bool)
                    alive[np.array(at)] = True
                    now = now[alive[before]]
                else:
                    now, = chosen(x, levels, 0)
                now = np.unique(now)
                h = window_hashes(x, levels[k])[now]
                h2 = window_hashes(x, levels[k], BASES[1])[now] if last else np.zeros(len(now), np.uint64)
                parts.append((h, h2, np.full(len(now), i), np.full(len(now), rid), now))
                size += len(now)
                if size > FLUSH_ROWS:
                    yield from flush(parts)
                    parts, size = [], 0
        yield from flush(parts)

    def flush(parts):
        if not parts:
            return
        h, h2, i, rid, at = map(np.concatenate, zip(*parts))
        least, more = settle(h, i)
        # last level: a later document's row is a hit; before: any row of a shared hash survives
        settled = ~least if last else more
        salt = np.where(least, 0, rid + 1)
        h, h2 = np.where(least, h, 0), np.where(least, h2, 0)
        for s in range(0, len(h), 1 << 17):
            j = slice(s, s + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[j]) for c in (h.view(np.int64), h2.view(np.int64), salt, i, rid, at.astype(np.int32), settled)],
                ["h", "h2", "salt", "id", "rid", "place", "settled"])
    return docs.select("rid", "id", "text", *(["places"] if k else [])).mapInArrow(
        run, "h long, h2 long, salt long, id long, rid long, place int, settled boolean")


def _survivors(rows: DataFrame, last: bool) -> DataFrame:
    """(rid, places) of the rows whose window is in another document (last level: in an earlier one)."""
    dealt = rows.repartition(partitions(rows.sparkSession), "h", "h2", "salt")
    group = (dealt.filter("salt = 0").groupBy("h", "h2", "salt").agg(F.min("id").alias("low"), F.max("id").alias("high"))
             .filter("low < high"))
    kept = dealt.join(group.hint("shuffle_hash"), ["h", "h2", "salt"], "left").filter("settled or id > low" if last else "settled or low is not null")
    return kept.groupBy("rid").agg(F.collect_list("place").alias("places"))


def _cut(window: int):
    def run(batches):
        for b in batches:
            texts, words, gone = [], [], []
            for t, at, copy in zip(texts_of(b), b.column("places").to_pylist(), b.column("copy").to_pylist()):
                w = t.split()
                if copy:
                    flags = np.full(len(w), len(w) >= window)
                else:
                    flags = cover(np.array(at or [], np.int64), window, len(w))
                words.append(len(w)), gone.append(int(flags.sum()))
                texts.append(b" ".join(w if not gone[-1] else [x for x, f in zip(w, flags.tolist()) if not f]))
            i = b.schema.get_field_index("text")
            b = b.set_column(i, "text", pa.array(texts, pa.binary()).cast(b.schema.field("text").type)).drop_columns(["places", "copy"])
            yield b.append_column("n_words", pa.array(words, pa.int64())).append_column("n_removed", pa.array(gone, pa.int64()))
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """``docs`` with ``text`` as the kept words joined by one space, plus n_words and n_removed (long)."""
    spark = docs.sparkSession
    prepare(spark)
    levels = lengths(first, window)
    rows = keyed_table(plain(docs), "substring_docs")
    keyed = rows.select("rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    digests = keyed.select("rid", "id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2"))
    least = digests.groupBy("d1", "d2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    copies = materialize(digests.join(least, ["d1", "d2"]).filter("id > low").select("rid", F.lit(True).alias("copy")), "copies")
    search = keyed.join(copies.hint("shuffle_hash"), "rid", "left_anti")
    found = None
    for k in range(len(levels)):
        at = search if found is None else search.join(found.hint("shuffle_hash"), "rid")
        found = materialize(_survivors(_rows(at, k, levels), k == len(levels) - 1), "places")
        if found.isEmpty():
            break
    done = (rows.join(found.hint("shuffle_hash"), "rid", "left").join(copies.hint("shuffle_hash"), "rid", "left").drop("rid"))
    schema = done.drop("places", "copy").schema.add("n_words", "long").add("n_removed", "long")
    return restored(done.mapInArrow(_cut(window), schema), docs, "n_words", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM w) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM hit),
kept AS (SELECT x.doc_id, count(gone.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS text
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
