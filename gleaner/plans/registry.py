"""Query registry: one Spark job and (where SQL can say it) one DuckDB oracle per operator.

``register(name, oracle)`` records a callable ``(spark, sf_dir) -> DataFrame``
and the DuckDB SQL that must give the same rows on the same parquet tables.
Results hold scalar columns only (BIGINT, DOUBLE rounded to 6 places, STRING,
BOOLEAN) so the two engines can be compared value by value.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_code

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

#: Bounds of the batches that go to Python workers.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def tune(spark: SparkSession) -> None:
    """Session settings the jobs rely on.

    Constraint propagation is switched off: the gate and report operators build
    wide alias chains, and inferring constraints over them costs the optimizer
    far more than it can save (seconds per plan with no rule ever firing).
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    # a Python worker holds a batch of texts and what is made of them, several times over
    for key, value in ARROW_BATCH.items():
        spark.conf.set(key, value)
    # event times are zone-less; interval arithmetic and watermarks run in UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_code(spark)


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its ``register`` calls run."""
    from . import (  # noqa: F401
        q_funnel,
        q_monitor,
        q_cluster,
        q_dedup,
        q_text,
        q_verdicts,
        q_clustering,
        q_stream,
        q_plugins,
    )
