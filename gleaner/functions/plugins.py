"""Plug points: text embedder (F03), text splitter UDTF (F04), health checks.

F01 (verdict scorer) lives in ``operators.verdicts`` and F02 (alert delivery) in
``streaming.streams``; F05 (vector mean) is ``cluster_stats.centroids``.
"""

from __future__ import annotations

import functools
import hashlib
import re
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# F03 embedder in batches of 32
# ---------------------------------------------------------------------------
def hashing_model(dim: int = 384) -> Callable[[np.ndarray], np.ndarray]:
    """Default deterministic embedder: counts of words (split at ASCII space, lower case) by the
    first 32 bits of their MD5, L2-normalised.  A real sentence model plugs in through the
    same ``make_model`` signature."""
    place = functools.lru_cache(maxsize=1 << 16)(lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim)

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            words = re.findall(r"[^\x20\x09-\x0D]+", str(t or "").lower())
            out[i] = np.bincount(np.fromiter(map(place, words), np.int64, len(words)), minlength=dim)
            n = np.linalg.norm(out[i])
            if n > 0:
                out[i] /= n
        return out
    return predict


def embed_batches(df: DataFrame, text_col: str, make_model: Callable[[], Callable] | None = None,
                  dim: int = 384, batch_size: int = 32, out: str = "embedding") -> DataFrame:
    """``predict_batch_udf`` — the model is loaded once per Python worker and called
    on batches of ``batch_size`` texts."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    loader = make_model or (lambda: hashing_model(dim))
    udf = predict_batch_udf(loader, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))


# ---------------------------------------------------------------------------
# F04 separator-aware splitter
# ---------------------------------------------------------------------------
SEPARATORS = ["\n\n", "\n", " ", ""]


def split_recursive(text: str, size: int, overlap: int, seps=tuple(SEPARATORS)) -> list[str]:
    """Split at the coarsest separator that occurs, recurse into pieces still too long,
    then pack pieces into chunks of at most ``size`` characters with ``overlap``."""
    if text is None:
        return []
    if len(text) <= size:
        return [text] if text else []
    sep = next((s for s in seps if s and s in text), "")
    rest = seps[seps.index(sep) + 1:] if sep in seps else ()
    parts = list(text) if sep == "" else text.split(sep)
    pieces: list[str] = []
    for p in parts:
        if len(p) > size and rest:
            pieces.extend(split_recursive(p, size, overlap, rest))
        elif p:
            pieces.append(p)
    chunks, cur = [], []
    cur_len = 0
    for p in pieces:
        add = len(p) + (len(sep) if cur else 0)
        if cur and cur_len + add > size:
            chunks.append(sep.join(cur))
            while cur and (cur_len > overlap or cur_len + len(p) + len(sep) > size):
                cur_len -= len(cur[0]) + (len(sep) if len(cur) > 1 else 0)
                cur.pop(0)
            add = len(p) + (len(sep) if cur else 0)
        cur.append(p)
        cur_len += add
    if cur:
        chunks.append(sep.join(cur))
    return [c for c in chunks if c]


#: Texts that are split, with their chunks, at a time.
SPLIT_ROWS = 256


def split_texts(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, pos, chunk) of every text, in Arrow batches of ``SPLIT_ROWS`` texts at most; null and empty
    texts have no chunk."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in (x.slice(s, SPLIT_ROWS) for x in batches for s in range(0, x.num_rows, SPLIT_ROWS)):
            ids, pos, chunks = [], [], []
            for i, t in enumerate(b.column(text_col).to_pylist()):
                found = split_recursive(t, size, overlap)
                ids += [i] * len(found)
                pos += range(len(found))
                chunks += found
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(ids, pa.int64())), pa.array(pos, pa.int32()), pa.array(chunks, pa.string())],
                                             [id_col, "pos", "chunk"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, pos int, chunk string")


def register_split_text(spark: SparkSession, name: str = "split_text"):
    """F04 in SQL: the splitter as a Python UDTF for lateral joins (row by row; ``split_texts``
    is the form for tables)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, chunk string")
    class SplitText:
        def eval(self, text: str, size: int, overlap: int):
            for i, c in enumerate(split_recursive(text, size, overlap)):
                yield i, c

    spark.udtf.register(name, SplitText)
    return SplitText


# ---------------------------------------------------------------------------
# F06 health checks over DataFrames
# ---------------------------------------------------------------------------
CheckFn = Callable[[], tuple[str, str]]


def run_health_checks(spark: SparkSession, checks: dict[str, CheckFn]) -> DataFrame:
    """run each registered check (a function returning (status, message), usually
    from a one-row aggregate); a check that raises reports status 'error'."""
    rows = []
    for name, fn in checks.items():
        t0 = time.time()
        try:
            status, message = fn()
        except Exception as e:  # noqa: BLE001 — a check is user code
            status, message = "error", f"{type(e).__name__}: {e}"
        rows.append((name, status, message, time.time() - t0))
    return spark.createDataFrame(rows, "name string, status string, message string, duration_seconds double")
