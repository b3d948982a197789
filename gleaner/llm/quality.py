"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed byte trigrams plus a few shape terms (shares of
repeated words, capitals and symbols, in steps). Terms are weighted by
log(1 + count) and by the inverse document frequency over all documents; the
singular vectors of the labelled sample's matrix project a text to ``DIMS``
latent dimensions. The labelled vectors (at most ``SAMPLE`` of them, the
documented bound of the fit) are broadcast; every document's cosines with all
of them are exact blocked products, and its ``NEIGHBOURS`` nearest vote with
their similarity as weight.

Edge cases: null and empty texts have no terms, hence no neighbours: they score
the sample's share of label 1. Labels that are null or belong to no document
are not used; a doc_id labelled twice counts with its smallest label, and of rows
with one labelled doc_id that with the least text hash is learned. Of equal
similarities (to six decimals) the earlier sample row (smaller doc_id) votes. Without any usable
label every score is 0.5. A null doc_id is not held out and never labelled. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, prepare, restored, texts_of

#: Most labelled rows that the model is fitted on and broadcasts (a hash order picks them).
SAMPLE = 4096
HASHED, STEPS, DIMS, NEIGHBOURS, THRESHOLD, PRIOR_WEIGHT = 2048, 8, 64, 15, 0.3, 0.05
TERMS = HASHED + 4 * STEPS
SHAPE_COUNT = 20.0
PIECE = 1 << 20


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def term_counts(text: bytes) -> np.ndarray:
    """Counts of the ``TERMS`` terms in a whole text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    a = np.frombuffer(text, np.uint8)
    for i in range(0, len(a), PIECE):
        x = a[i:i + PIECE + 2].astype(np.uint32)
        if len(x) > 2:
            h = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(21)
            out[:HASHED] += np.bincount(h, minlength=HASHED)
    w = text.split()
    if w:
        n = len(w)
        letters = np.bincount(a, minlength=256)
        capitals, spaces = letters[65:91].sum(), letters[9:14].sum() + letters[32]
        alnum = letters[48:58].sum() + capitals + letters[97:123].sum() + letters[128:].sum()
        shares = (sum(map(bytes.__eq__, w, w[1:])) / n, len(set(w)) / n ** 0.8, capitals / len(a),
                  1 - alnum / max(1, len(a) - spaces))
        for k, (s, top) in enumerate(zip(shares, (0.4, 1.6, 0.4, 0.4))):
            out[HASHED + k * STEPS + min(STEPS - 1, int(s / top * STEPS))] = SHAPE_COUNT
    return out


def weigh(x: np.ndarray, idf: np.ndarray) -> None:
    """Counts to weights of unit length, in place."""
    for i in range(0, len(x), 256):
        part = x[i:i + 256]
        np.log1p(part, out=part)
        part *= idf
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    weigh(x, idf)
    return x


def held_out(column: str = "doc_id"):
    """True for the fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term is: over the whole table."""
    def run(batches):
        df, n = np.zeros(TERMS + 1, np.int64), 0
        for b in batches:
            for t in texts_of(b):
                df[:TERMS] += term_counts(t) > 0
                n += 1
        df[TERMS] = n
        yield pa.RecordBatch.from_pydict({"term": np.arange(TERMS + 1), "n": df})
    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    df = np.zeros(TERMS + 1)
    for r in rows:
        df[r.term] = r.n
    return int(df[TERMS]), df[:TERMS]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, quality), never from the held-out fold."""
    prepare(docs.sparkSession)
    picked = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
              .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `sample` ids

    def run(batches):
        for b in batches:
            c = np.stack([term_counts(t) for t in texts_of(b)]) if b.num_rows else np.zeros((0, TERMS), np.float32)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "label": b.column("_label"),
                                              "counts": pa.array([x.astype(np.float16).tobytes() for x in np.minimum(c, 60000)], pa.binary())})
    # of rows with one doc_id the one with the least text hash
    rows = rows.groupBy("doc_id", "_label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = {r.doc_id: (r.label, r.counts) for r in rows.mapInArrow(run, "doc_id long, label int, counts binary").toLocalIterator()}
    n, df = document_frequency(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    if not got:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    ids = sorted(got)
    y = np.array([got[i][0] > 0 for i in ids], np.float32)
    x = np.empty((len(ids), TERMS), np.float32)
    for k, i in enumerate(ids):
        x[k] = np.frombuffer(got.pop(i)[1], np.float16)
    weigh(x, idf)
    axes = top_axes(x, min(DIMS, *x.shape))
    return Model(idf, axes, unit(x @ axes), y, float(y.mean()))


def top_axes(x: np.ndarray, k: int, spare: int = 8, rounds: int = 12) -> np.ndarray:
    """The first ``k`` right singular vectors of ``x`` by subspace iteration: no square matrix of terms."""
    k_all = min(k + spare, x.shape[1])
    q = np.random.default_rng(0).standard_normal((x.shape[1], k_all)).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    y = x @ q
    _, v = np.linalg.eigh((y.T @ y).astype(np.float64))
    return np.ascontiguousarray(q @ v[:, ::-1][:, :k].astype(np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` highest values; of equal ones the left."""
    last = np.partition(cos, -k, axis=1)[:, -k, None]
    above, equal = cos > last, cos == last
    take = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(cos), k)


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """Scores of the rows of ``counts``."""
    if not len(model.vectors):
        return np.full(len(counts), 0.5)
    k = min(NEIGHBOURS, len(model.vectors))
    cos = np.round(unit(weighted(counts, model.idf) @ model.axes) @ model.vectors.T, 6)  # equal vectors have equal values
    near = nearest(cos, k)
    w = np.maximum(np.take_along_axis(cos, near, axis=1).astype(np.float64), 0) ** 4
    return (np.einsum("ij,ij->i", w, model.labels[near]) + PRIOR_WEIGHT * model.prior) / (w.sum(axis=1) + PRIOR_WEIGHT)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every row of ``docs``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            t, ids = texts_of(b), b.column(id_column)
            for i in range(0, len(t), 256):
                s = vote(shared.value, np.stack([term_counts(x) for x in t[i:i + 256]]))
                yield pa.RecordBatch.from_pydict({id_column: ids[i:i + 256], "score": s})
    return docs.select(id_column, "text").mapInArrow(run, f"{id_column} long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = plain(docs)

    def run(batches):
        for b in batches:
            t = texts_of(b)
            for i in range(0, len(t), 256):
                s = vote(shared.value, np.stack([term_counts(x) for x in t[i:i + 256]]))
                yield b.slice(i, 256).filter(pa.array(s >= threshold))
    return restored(rows.mapInArrow(run, rows.schema), docs)
