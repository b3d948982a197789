"""Document fingerprints by content-defined chunking.

A text's UTF-8 bytes are cut where a 32-byte gear hash is zero under a mask: a
stricter mask before ``NORMAL`` bytes, a looser one after (normalised
chunking), never before ``SHORTEST`` and always at ``LONGEST``. A cut depends
on the bytes just before it and on the cut before, so an insertion shifts the
text but only changes the chunks around it. The fingerprint is the sorted set
of (40-bit digest, length) of the chunks, base64 of six bytes each. The
likeness of A to B is the share of A's chunk bytes that are in B (containment).

``edited_report`` compares each document with an edited text made from the next
document in descending doc_id. The order is dealt in ranges of doc_id; a range
also gets the first document of the range after it, so the texts move once.

Edge cases: null counts as empty; an empty text has the empty fingerprint, like
itself (1) and unlike any other (0; others are 0 to it). Rows with equal doc_id
follow one another in the order of their texts, null doc_ids come last. A
single row is its own next document. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare

SHORTEST, NORMAL, LONGEST = 24, 48, 255
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
#: The gear table: a fixed pseudo-random word for each byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 42) for b in range(256)], np.uint32)
PIECE, PIECE_ROWS = 1 << 20, 50_000


def gear_hash(a: np.ndarray) -> np.ndarray:
    """Of each place: the sum of the gear words of the last 32 bytes, each shifted by its distance."""
    h = GEAR[a]
    for s in (1, 2, 4, 8, 16):
        more = h.copy()
        more[s:] += h[:-s] << np.uint32(s)
        h = more
    return h


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks."""
    n, loose, strict = len(text), [], []
    a = np.frombuffer(text, np.uint8)
    for i in range(0, n, PIECE):
        lead = min(i, 31)
        h = gear_hash(a[i - lead:i + PIECE])[lead:]
        at = np.flatnonzero((h & LOOSE) == 0)
        loose.append(at + (i + 1)), strict.append(at[(h[at] & STRICT) == 0] + (i + 1))
    loose = np.concatenate(loose).tolist() if loose else []
    strict = np.concatenate(strict).tolist() if strict else []
    out, start, j, k = [], 0, 0, 0
    while start < n:
        j = bisect_left(strict, start + SHORTEST, j)
        if j < len(strict) and strict[j] < start + NORMAL:
            end = strict[j]
        else:
            k = bisect_left(loose, start + NORMAL, k)
            end = min(loose[k] if k < len(loose) else n, start + LONGEST, n)
        out.append(end)
        start = end
    return out


def chunk_set(text: bytes) -> np.ndarray:
    """Sorted distinct chunks, each as digest << 8 | length."""
    ends = cuts(text)
    starts = [0, *ends[:-1]]
    digest = np.fromiter((xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(starts, ends)), np.uint64, len(ends))
    size = np.array(ends, np.uint64) - np.array(starts if ends else [], np.uint64)
    return np.unique((digest >> np.uint64(24)) << np.uint64(8) | size)


def encode(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a):
        return float(not len(b))
    size = a & np.uint64(255)
    return float(size[np.isin(a, b, assume_unique=True)].sum() / size.sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, fingerprint) of every row of ``docs``."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = [chunk_set((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([encode(s) for s in sets], pa.string())], ["doc_id", "n_chunks", "fingerprint"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chunks long, fingerprint string")


def _dealt(docs: DataFrame) -> DataFrame:
    """(piece, look, doc_id, text): ranges of descending doc_id; look marks the first rows of the range after."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (-F.col("doc_id").cast("double")).alias("_key"))
    n = max(partitions(spark), -(-docs.count() // PIECE_ROWS))
    bounds = d.approxQuantile("_key", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    splits = [-float("inf"), *sorted(set(bounds)), float("inf")]
    if len(splits) > 2:
        d = Bucketizer(splits=splits, inputCol="_key", outputCol="_b", handleInvalid="keep").transform(d)
    else:
        d = d.withColumn("_b", F.lit(0.0))
    d = d.withColumn("piece", F.when(F.col("doc_id").isNull(), len(splits)).otherwise(F.col("_b").cast("int")))
    heads = sorted((r.piece, r.doc_id) for r in d.groupBy("piece").agg(F.max("doc_id").alias("doc_id")).collect())  # one for each range
    into = [(heads[i - 1][0], p, h) for i, (p, h) in enumerate(heads)]
    into = F.broadcast(spark.createDataFrame(into, "_into int, _p int, _h long"))
    d = d.join(into, (F.col("piece") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("_h")), "left")
    place = lambda p, look: F.struct(p.alias("piece"), F.lit(look).alias("look"))
    d = d.select("doc_id", "text", F.explode(F.when(F.col("_p").isNull(), F.array(place(F.col("piece"), False))).otherwise(
        F.array(place(F.col("piece"), False), place(F.col("_into"), True)))).alias("_x"))
    d = d.select("_x.piece", "_x.look", "doc_id", "text")
    return d.repartition(partitions(spark), "piece").sortWithinPartitions("piece", "look", F.col("doc_id").desc_nulls_last(), "text")


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are."""
    prepare(docs.sparkSession)

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None  # piece, doc_id, text, chunks of a row that waits for its next
        for b in batches:
            out = []
            for piece, look, i, t in zip(*(b.column(c).to_pylist() for c in ("piece", "look", "doc_id", "text"))):
                if look and last is None:
                    continue
                own = chunk_set(t.encode())
                if last is not None and last[0] == piece:
                    _, di, dt, dc = last
                    half = len(dt) // 2
                    edited = (dt[:len(dt) - half] + t[:half]).encode()
                    ec = chunk_set(edited)
                    out.append((di, len(dt), sha256(edited).hexdigest(), encode(dc), encode(ec), likeness(dc, ec), likeness(dc, own)))
                last = None if look else (piece, i, t, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, types)], names)
    return _dealt(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                        "edited_fingerprint string, near_edited double, near_next double")
