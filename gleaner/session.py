"""Session helpers: building a local session for tests and cutting lineage.

Library code never creates its own session; every operator takes DataFrames
(and, where a job needs it, the session they belong to).  ``local_session`` is
only for tests, the bench and the smoke entry point.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gleaner") -> SparkSession:
    """Session for tests and local runs (UTC, AQE on, Arrow on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (a shared file system); we never
    invent a machine-local one there.  Only a local-mode session without the
    setting (tests, the bench) gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError(
                    "spark.checkpoint.dir is not set; iterative jobs need a shared folder to cut lineage")
            configured = tempfile.mkdtemp(prefix="gleaner-ckpt-")
        sc.setCheckpointDir(configured)
        current = sc._jsc.sc().getCheckpointDir()  # qualified by the session's file system
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: materialise ``df`` in the shared checkpoint folder.

    Used between rounds of iterative jobs so plans stay short and a lost
    executor does not force recomputation from the first round.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Path of a fresh folder under the checkpoint folder for an intermediate table.

    Only a path: Spark's writers create it through the session's file system,
    so nothing here touches the driver's own disk.
    """
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read back.

    For iterative jobs that join their own rounds: a table's size is measured,
    while a checkpoint keeps the planner's estimate, which such joins square
    every round.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str = "round", **metrics: Column) -> tuple[DataFrame, dict]:
    """``written`` and, from the same pass, the number ``rows`` of rows and other aggregates."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())), name)
    return out, seen.get


_SHIPPED: set[int] = set()


def ship_code(spark: SparkSession) -> None:
    """Make the package importable by the Python workers (UDF and kernel code).

    Workers do not see the driver's ``sys.path``; the package is zipped once per
    SparkContext and sent with ``addPyFile`` (on a cluster this reaches every
    executor)."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="gleaner-code-")
    archive = shutil.make_archive(os.path.join(out, "gleaner"), "zip", os.path.dirname(pkg), "gleaner")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))
