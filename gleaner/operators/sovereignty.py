"""Rule and thesis dimensions, filter modes and the sovereignty filters.

Dimension tables are tiny (tens of rows, fixed by configuration), so every
join against them is an explicit broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P

RULE_SCHEMA = "id int, title string, description string, keywords array<string>"
THESIS_SCHEMA = "id int, title string, text string, category string, keywords array<string>"


def _load_dimension(spark: SparkSession, path: str, key: str, schema: str, required: list[str]) -> DataFrame:
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.explode(key).alias("r")).select("r.*")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) if c in rows.columns else F.lit(c)
                                        for c in required]))
    # fail the job (not silently drop) when a row lacks a required field
    checked = rows.withColumn("_missing", missing).filter(
        F.when(F.size("_missing") > 0, F.raise_error(F.concat(F.lit(f"{key} row missing fields: "),
                                                                F.array_join("_missing", ", "))))
         .otherwise(F.lit(True)))
    cols = [c.split()[0] for c in schema.split(", ")]
    return checked.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in cols])


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows from the JSON config; a row without id/title/description/keywords fails the job."""
    return _load_dimension(spark, path, "axioms", RULE_SCHEMA, ["id", "title", "description", "keywords"])


def load_theses(spark: SparkSession, path: str) -> DataFrame:
    """Thesis rows (with category) from the JSON config; same checks."""
    return _load_dimension(spark, path, "theses", THESIS_SCHEMA, ["id", "title", "text", "category", "keywords"])


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.RULES, "id int, title string")


def thesis_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.THESES, "id int, title string, category string")


def mode_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.FILTER_MODES, "mode string, max_violations int, threshold double")


def status_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.REALITY_STATUSES, "status string, requires_full_analysis boolean")


def threshold_for(df: DataFrame, modes: DataFrame, mode_col: str = "mode") -> DataFrame:
    """Mode → threshold and max violations; an unknown mode fails the job."""
    j = df.join(F.broadcast(modes), df[mode_col] == modes["mode"], "left").drop(modes["mode"])
    return j.withColumn("threshold", F.when(F.col("threshold").isNull(),
                                            F.raise_error(F.concat(F.lit("unknown filter mode: "), F.col(mode_col))))
                        .otherwise(F.col("threshold")))


def threshold_filter(df: DataFrame, modes: DataFrame, mode: str, override: float | None = None,
                     score_col: str = "sovereignty_relevance_score") -> DataFrame:
    """Keep score/10 ≥ the mode's threshold; an explicit override wins."""
    if override is not None:
        return df.filter(F.col(score_col) / 10.0 >= override)
    t = modes.filter(F.col("mode") == mode).select("threshold")
    return df.crossJoin(F.broadcast(t)).filter(F.col(score_col) / 10.0 >= F.col("threshold")).drop("threshold")


def min_alignment(df: DataFrame, n: int = P.MIN_ALIGNED_THESES, col: str = "aligned_theses") -> DataFrame:
    """At least ``n`` aligned theses."""
    return df.filter(F.coalesce(F.size(col), F.lit(0)) >= n)


def max_violations(df: DataFrame, modes: DataFrame, mode: str) -> DataFrame:
    """violation_count within the mode's limit."""
    m = modes.filter(F.col("mode") == mode).select("max_violations")
    return df.crossJoin(F.broadcast(m)).filter(
        F.coalesce(F.col("violation_count"), F.lit(0)) <= F.col("max_violations")).drop("max_violations")


def full_analysis_flag(df: DataFrame, statuses: DataFrame) -> DataFrame:
    """Whether the row's reality status needs rule analysis (RUMOR does not)."""
    return df.join(F.broadcast(statuses), df["reality_status"] == statuses["status"], "left").drop("status")


def rule_lookup(df: DataFrame, rules: DataFrame, id_col: str = "rule_id") -> DataFrame:
    """A rule id → its title (null when the id is unknown; the row is kept)."""
    return df.join(F.broadcast(rules.select(F.col("id").alias(id_col), F.col("title").alias("rule_title"))), id_col, "left")


def thesis_lookup(df: DataFrame, theses: DataFrame, ids_col: str = "aligned_theses") -> DataFrame:
    """Each aligned thesis id → its title (null when the id is unknown; the row is kept)."""
    ex = df.select("item_id", F.posexplode_outer(ids_col).alias("pos", "thesis_id"))
    return ex.join(F.broadcast(theses.select(F.col("id").alias("thesis_id"), "title", "category")),
                   "thesis_id", "left")
