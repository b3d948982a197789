"""Table sinks: report rows, header checks, synthesis rows.

Sinks write to a table location on the shared file system (parquet, or a
catalog table through ``saveAsTable``); appends never rewrite earlier data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows to the report table."""
    df.write.mode("append").parquet(path)


def header_matches(spark: SparkSession, path: str, expected: Sequence[str]) -> DataFrame:
    """Do the stored columns match ``expected`` (trimmed, case-blind, in order)?
    One row; ``needs_header`` is true when the table is missing or differs."""
    try:
        cols = spark.read.parquet(path).columns
    except AnalysisException:
        cols = []
    ok = [c.strip().lower() for c in cols] == [c.strip().lower() for c in expected]
    return spark.createDataFrame([(ok, not ok, len(cols))], "header_ok boolean, needs_header boolean, stored_columns int")


def append_synthesis(row: DataFrame, path: str) -> None:
    """Append one synthesis row (date, theme, text, item count); the table is made if missing."""
    row.select(F.col("date").cast("string"), F.col("theme").cast("string"), F.col("text").cast("string"),
               F.col("item_count").cast("long")).write.mode("append").parquet(path)
