"""Helpers shared by the training-text operators: row keys, intermediate tables, code shipping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_code

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and bound the Arrow batches (long texts)."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs the running stage only, and row numbers
    given by ``monotonically_increasing_id`` are fixed from here on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """``materialize`` and, from the same pass, the number ``n`` of rows and other aggregates."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in metrics.items())), name)
    return out, seen.get


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_table(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus ``rid`` (a unique row number), written as a table bucketed by ``rid``.

    The texts cross the network once; every later join on ``rid`` brings only
    its small side to them.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    (docs.withColumn("rid", F.monotonically_increasing_id()).repartition(n, "rid")
     .write.format("parquet").option("compression", "zstd").bucketBy(n, "rid").option("path", scratch_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def batch_of(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list:
    """The column's values as UTF-8 bytes; null as empty."""
    c = batch.column(column)
    return [x or b"" for x in c.cast(pa.large_binary()).to_pylist()]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def cover(starts: np.ndarray, length, n: int) -> np.ndarray:
    """Flags of the ``n`` places covered by [start, start + length)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:n]) > 0


def dense_positions(ids: DataFrame, name: str, *order) -> DataFrame:
    """``ids`` plus ``pos``: 0, 1, 2, ... in the given order, without a global window.

    The rows are range-partitioned and sorted; a row's position is its place in
    its partition plus the sizes of the partitions before (one number for each).
    """
    spark = ids.sparkSession
    s = materialize(ids.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33).cast("int")
    sizes = sorted((r.p, r.n) for r in s.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, total = [], 0
    for p, n in sizes:
        rows.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(rows, "_p int, _off long"))
    return s.join(offsets, part == F.col("_p")).select(
        *ids.columns, (F.col("_off") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("pos"))


def plain(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the other columns as x0, x1, ...: no name can clash with a working column."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *(docs[f"`{c}`"].alias(f"x{i}") for i, c in enumerate(rest)))


def restored(df: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """Back to the columns of ``docs``, then ``added``; an added column replaces one of its name."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {"doc_id": "doc_id", "text": "text"} | {c: f"x{i}" for i, c in enumerate(rest)}
    return df.select(*(F.col(names[c]).alias(c) for c in docs.columns if c not in added), *added)
