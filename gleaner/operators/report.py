"""Display rows of the digest report (28 ordered string columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — report header, in order
REPORT_HEADER = [
    "Story Master Headline", "Headline", "Short description", "Source", "Date", "Companies", "Technologies",
    "Reality Status", "Reality Reason", "Violation Count", "Top Violations", "Minimal Repairs",
    "Implication: US", "Implication: EU", "Implication: China", "Implication: Rest of Asia", "LinkedIn Angle",
    "Relevance Tier", "Quality Gate",
    "Cluster ID", "Cluster Size", "Is Noise", "Cluster Probability", "Representative Items",
    "Cluster Synthesis", "Cluster Thesis",
    "Kill Gate", "Kill Gate Reason",
]

REPORT_COLUMNS = [h.lower().replace(":", "").replace(" ", "_") for h in REPORT_HEADER]


def report_row(df: DataFrame) -> DataFrame:
    """Project an enriched item frame onto the report columns (all strings).

    Expects the item fields plus tier, gate, cluster and verdict columns;
    rows always carry every cluster column (noise → 'NOISE', size 1).
    """
    have = set(df.columns)

    def col(c: str) -> Column:
        return F.col(c) if c in have else F.lit(None)

    def _s(c: str, default: str) -> Column:
        return F.coalesce(col(c).cast("string"), F.lit(default))

    prob = col("cluster_probability")
    cols = [
        F.coalesce(col("master_headline"), col("headline"), F.lit("N/A")),
        _s("headline", "N/A"), _s("short_description", "N/A"), _s("source", "N/A"), _s("date", "N/A"),
        F.array_join(F.coalesce(col("companies"), F.array().cast("array<string>")), ", "),
        F.array_join(F.coalesce(col("technologies"), F.array().cast("array<string>")), ", "),
        _s("reality_status", "N/A"), _s("reality_reason", "N/A"),
        F.coalesce(col("violation_count"), F.lit(0)).cast("string"),
        _s("top_violations_formatted", "None"), _s("minimal_repairs_formatted", "None"),
        _s("region_us", ""), _s("region_eu", ""), _s("region_cn", ""), _s("region_asia", ""),
        _s("linkedin_angle", ""), _s("relevance_tier", "N/A"), _s("quality_gate", "N/A"),
        F.when(col("cluster_id") == -1, F.lit("NOISE")).otherwise(col("cluster_id").cast("string")),
        F.coalesce(col("cluster_size"), F.lit(1)).cast("string"),
        F.when(F.coalesce(col("is_noise"), F.lit(False)), F.lit("Yes")).otherwise(F.lit("No")),
        F.when(prob.isNull(), F.lit("N/A")).otherwise(F.format_string("%.3f", prob)),
        _s("representative_items", ""),
        F.when(col("cluster_synthesis").isNull(), F.lit("N/A"))
         .when(col("cluster_synthesis"), F.lit("True")).otherwise(F.lit("False")),
        _s("cluster_thesis", ""), _s("kill_gate", "N/A"), _s("kill_gate_reason", ""),
    ]
    keep = [c for c in ("item_id",) if c in df.columns]
    return df.select(*keep, *[c.alias(n) for c, n in zip(cols, REPORT_COLUMNS)])
