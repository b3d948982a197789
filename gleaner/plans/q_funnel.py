"""Queries for the rule funnel (tier, counts, gates, score, caps) and item text keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalise_headline, token_set, truncate
from ..operators import gates
from ..sources.fixtures import FIXTURE_CORE_PATTERNS as CORE, FIXTURE_SHOPPING_WORDS as SHOP
from ..sources.fixtures import ITEMS_DUCK, items, with_ctes
from . import duck as D
from .funnel import rule_funnel, stage_flags
from .registry import register

# ----------------------------------------------------------------------------
# DuckDB twins of the gate stages (CTE bodies over ``items``)
# ----------------------------------------------------------------------------
_TIER_DUCK = f"""
tiered AS (
  SELECT *, CASE WHEN {D.any_pattern("lower(concat_ws(' ', headline, short_description))", CORE)}
                 THEN 'CORE' ELSE 'ADJACENT' END AS relevance_tier
  FROM items
)"""

_COUNTS_DUCK = f"""
counted AS (
  SELECT *, {D.count_judgment('ALIGNED', 10)} AS aligned_count,
            {D.count_judgment('TENSION')} AS tension_count,
            {D.count_judgment('VIOLATION')} AS violation_judgments,
            {D.count_judgment('N/A')} AS na_count,
            coalesce(linkedin_angle, '') AS angle
  FROM tiered
)"""

_GATE_DUCK = """
reasoned AS (
  SELECT *, list_filter([
      CASE WHEN reality_status IN ('OPINION', 'ANALYSIS') AND violation_count = 0
           THEN reality_status || ' with zero violations — no structural tension' END,
      CASE WHEN angle = 'GENERIC_ANGLE' THEN 'GENERIC_ANGLE — no non-obvious take found'
           WHEN length(angle) < 100 THEN 'weak angle (' || CAST(length(angle) AS VARCHAR) || ' chars < 100 minimum)' END,
      CASE WHEN relevance_tier = 'CORE' AND NOT (aligned_count >= 3 OR tension_count + violation_judgments >= 1)
           THEN 'CORE but weak axiom engagement (aligned=' || CAST(aligned_count AS VARCHAR) || ', tv='
                || CAST(tension_count + violation_judgments AS VARCHAR) || ')' END,
      CASE WHEN relevance_tier = 'CORE' AND violation_judgments = 0 AND tension_count = 0
           THEN 'CORE with zero violations AND zero tensions — no structural tension' END,
      CASE WHEN relevance_tier <> 'CORE' AND violation_judgments < 1
           THEN 'ADJACENT with no VIOLATIONS (tensions=' || CAST(tension_count AS VARCHAR) || ' don''t count for ADJACENT)' END,
      CASE WHEN relevance_tier <> 'CORE' AND NOT coalesce(len(companies) > 0, FALSE)
                AND NOT coalesce(len(technologies) > 0, FALSE)
           THEN 'ADJACENT with no companies AND no technologies' END
    ], lambda r: r IS NOT NULL) AS reasons
  FROM counted
),
gated AS (
  SELECT *,
    CASE WHEN NOT coalesce(len(axiom_check) > 0, FALSE) THEN 'NO_DATA'
         WHEN len(reasons) = 0 THEN 'PASS' ELSE 'FAIL' END AS quality_gate,
    CASE WHEN NOT coalesce(len(axiom_check) > 0, FALSE) THEN NULL
         WHEN len(reasons) = 0 THEN 'tier=' || relevance_tier || ', aligned=' || CAST(aligned_count AS VARCHAR)
              || ', tensions=' || CAST(tension_count AS VARCHAR) || ', violations=' || CAST(violation_judgments AS VARCHAR)
              || ', angle_len=' || CAST(length(angle) AS VARCHAR)
         ELSE array_to_string(reasons, '; ') END AS quality_gate_detail
  FROM reasoned
)"""

_SEARCH = "lower(concat_ws(' ', headline, short_description, array_to_string(coalesce(technologies, []), ' ')))"

_PREKILL_DUCK = f"""
killed AS (
  SELECT *,
    CASE WHEN violation_count = 0 AND relevance_tier = 'ADJACENT' AND NOT {D.any_substring(_SEARCH, SHOP)}
         THEN 'No violations, ADJACENT tier, no shopping/commerce keywords'
         WHEN violation_count = 0 AND reality_status IN ('REPORTED', 'OPINION') AND NOT {D.any_pattern(_SEARCH, CORE)}
         THEN 'No violations, ' || reality_status || ', no core transactional keywords' END AS kill_gate_reason
  FROM gated
)"""

_SCORE_EXPR = """(CASE WHEN relevance_tier = 'CORE' THEN 30 ELSE 0 END
   + 10 * len(list_filter(coalesce(axiom_check, []), lambda x: x.judgment = 'VIOLATION'))
   + 3 * len(list_filter(coalesce(axiom_check, []), lambda x: x.judgment = 'TENSION'))
   + CASE reality_status WHEN 'CONFIRMED' THEN 20 WHEN 'REPORTED' THEN 10 WHEN 'ANALYSIS' THEN 5 ELSE 0 END
   + CASE WHEN coalesce(linkedin_angle, '') NOT IN ('', 'GENERIC_ANGLE') AND length(linkedin_angle) > 150 THEN 10
          WHEN coalesce(linkedin_angle, '') NOT IN ('', 'GENERIC_ANGLE') AND length(linkedin_angle) > 100 THEN 5
          ELSE 0 END
   + CASE WHEN coalesce(len(companies) > 0, FALSE) THEN 5 ELSE 0 END)"""


def _tiered(spark, sf):
    return gates.classify_tier(items(spark, sf), CORE)


# ----------------------------------------------------------------------------
@register("g01_classify_tier", with_ctes(ITEMS_DUCK, _TIER_DUCK) + "SELECT item_id, relevance_tier FROM tiered")
def g01_classify_tier(spark, sf):
    return _tiered(spark, sf).select("item_id", "relevance_tier")


@register("a01_judgment_counts", with_ctes(ITEMS_DUCK, _TIER_DUCK, _COUNTS_DUCK) +
          "SELECT item_id, aligned_count, tension_count, violation_judgments, na_count FROM counted")
def a01_judgment_counts(spark, sf):
    df = gates.judgment_counts(items(spark, sf))
    return df.select("item_id", *[F.col(c).cast("long").alias(c) for c in
                                  ("aligned_count", "tension_count", "violation_judgments", "na_count")])


@register("g02_quality_gate", with_ctes(ITEMS_DUCK, _TIER_DUCK, _COUNTS_DUCK, _GATE_DUCK) +
          "SELECT item_id, relevance_tier, quality_gate, quality_gate_detail FROM gated")
def g02_quality_gate(spark, sf):
    return gates.quality_gate(_tiered(spark, sf)).select(
        "item_id", "relevance_tier", "quality_gate", "quality_gate_detail")


@register("g03_pre_kill", with_ctes(ITEMS_DUCK, _TIER_DUCK, _COUNTS_DUCK, _GATE_DUCK, _PREKILL_DUCK) +
          "SELECT item_id, CASE WHEN kill_gate_reason IS NOT NULL THEN 'PRE_KILL' END AS kill_gate, kill_gate_reason "
          "FROM killed WHERE quality_gate IN ('PASS', 'NO_DATA')")
def g03_pre_kill(spark, sf):
    kept = gates.quality_kept(gates.quality_gate(_tiered(spark, sf)))
    return gates.pre_kill(kept, SHOP, CORE).select("item_id", "kill_gate", "kill_gate_reason")


@register("g04_keyword_any", with_ctes(ITEMS_DUCK) +
          f"SELECT item_id, {D.any_substring(_SEARCH, SHOP)} AS has_keyword FROM items")
def g04_keyword_any(spark, sf):
    return gates.keyword_any(items(spark, sf), SHOP).select("item_id", "has_keyword")


@register("k01_item_score", with_ctes(ITEMS_DUCK, _TIER_DUCK) +
          f"SELECT item_id, CAST({_SCORE_EXPR} AS BIGINT) AS score_tenths, CAST({_SCORE_EXPR} AS DOUBLE) / 10 AS score FROM tiered")
def k01_item_score(spark, sf):
    return gates.item_score(_tiered(spark, sf)).select("item_id", "score_tenths", "score")


_FUNNEL_DUCK = with_ctes(ITEMS_DUCK, _TIER_DUCK, _COUNTS_DUCK, _GATE_DUCK, _PREKILL_DUCK, f"""
alive AS (
  SELECT *, {_SCORE_EXPR} AS score_tenths FROM killed
  WHERE quality_gate IN ('PASS', 'NO_DATA') AND kill_gate_reason IS NULL
)""", """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score_tenths DESC, ord) AS rn, count(*) OVER () AS n FROM alive
)""") + """
SELECT item_id, headline, relevance_tier, quality_gate, CAST(score_tenths AS DOUBLE) / 10 AS score,
       CASE WHEN n > 8 THEN round(CAST(score_tenths AS DOUBLE) / 10, 2) END AS hard_cap_score
FROM ranked WHERE n <= 8 OR rn <= 8"""


def funnel_output(spark, sf_dir):
    out = rule_funnel(items(spark, sf_dir), CORE, SHOP)
    return out.select("item_id", "headline", "relevance_tier", "quality_gate", "score", "hard_cap_score")


@register("k02_hard_cap", _FUNNEL_DUCK)
def k02_hard_cap(spark, sf):
    return funnel_output(spark, sf)


@register("k03_top_for_synthesis", with_ctes(ITEMS_DUCK, _TIER_DUCK) + f"""
SELECT item_id, round(CAST({_SCORE_EXPR} AS DOUBLE) / 10, 2) AS write_priority_score
FROM tiered ORDER BY {_SCORE_EXPR} DESC, ord LIMIT 5""")
def k03_top_for_synthesis(spark, sf):
    return gates.top_for_synthesis(_tiered(spark, sf), 5).select("item_id", "write_priority_score")


@register("g14_gate_funnel", with_ctes(ITEMS_DUCK, _TIER_DUCK, _COUNTS_DUCK, _GATE_DUCK, _PREKILL_DUCK) + """
SELECT count(*) AS rows_in,
       CAST(count_if(quality_gate IN ('PASS', 'NO_DATA')) AS BIGINT) AS after_quality,
       CAST(count_if(quality_gate IN ('PASS', 'NO_DATA') AND kill_gate_reason IS NULL) AS BIGINT) AS after_pre_kill,
       CAST(count_if(relevance_tier = 'CORE') AS BIGINT) AS core_rows,
       CAST(count_if(quality_gate = 'NO_DATA') AS BIGINT) AS no_data_rows
FROM killed""")
def g14_gate_funnel(spark, sf):
    """Rows in and out of every gate in one pass over the labelled frame."""
    flags = stage_flags(items(spark, sf), CORE, SHOP)
    return flags.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if("passed_quality").alias("after_quality"),
        F.count_if("passed_pre_kill").alias("after_pre_kill"),
        F.count_if(F.col("relevance_tier") == "CORE").alias("core_rows"),
        F.count_if(F.col("quality_gate") == "NO_DATA").alias("no_data_rows"),
    )


@register("uc_rejects", with_ctes(ITEMS_DUCK, _TIER_DUCK, _COUNTS_DUCK, _GATE_DUCK, _PREKILL_DUCK) + """
SELECT item_id, 'quality' AS gate, quality_gate_detail AS reason FROM killed WHERE quality_gate = 'FAIL'
UNION ALL
SELECT item_id, 'pre_kill' AS gate, kill_gate_reason AS reason FROM killed
WHERE quality_gate IN ('PASS', 'NO_DATA') AND kill_gate_reason IS NOT NULL""")
def uc_rejects(spark, sf):
    """U-C: one rejects table with the gate and reason of every removed row."""
    flags = stage_flags(items(spark, sf), CORE, SHOP)
    q = flags.filter(F.col("quality_gate") == "FAIL").select(
        "item_id", F.lit("quality").alias("gate"), F.col("quality_gate_detail").alias("reason"))
    k = flags.filter(F.col("passed_quality") & (F.col("kill_gate") == "PRE_KILL")).select(
        "item_id", F.lit("pre_kill").alias("gate"), F.col("kill_gate_reason").alias("reason"))
    return q.unionByName(k)


@register("t07_truncate_text", with_ctes(ITEMS_DUCK) + """
SELECT item_id, substr(coalesce(short_description, ''), 1, 250) AS desc_250,
       substr(coalesce(linkedin_angle, ''), 1, 200) AS angle_200,
       substr(coalesce(headline, ''), 1, 50) AS headline_50,
       CASE WHEN length(coalesce(short_description, '')) > 100
            THEN substr(short_description, 1, 100) || '...' ELSE coalesce(short_description, '') END AS desc_100_dots
FROM items""")
def t07_truncate_text(spark, sf):
    return items(spark, sf).select(
        "item_id", truncate("short_description", 250).alias("desc_250"),
        truncate("linkedin_angle", 200).alias("angle_200"),
        truncate("headline", 50).alias("headline_50"),
        truncate("short_description", 100, ellipsis=True).alias("desc_100_dots"))


@register("t19_normalise_headline", with_ctes(ITEMS_DUCK) +
          f"SELECT item_id, {D.normalise_headline('master_headline')} AS story_key FROM items")
def t19_normalise_headline(spark, sf):
    return items(spark, sf).select("item_id", normalise_headline("master_headline").alias("story_key"))


@register("t20_token_set", with_ctes(ITEMS_DUCK) + f"""
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(str_split({D.normalise_headline('master_headline')}, ' '),
       lambda w: w <> ''))), ' ') AS tokens,
       len(list_distinct(list_filter(str_split({D.normalise_headline('master_headline')}, ' '), lambda w: w <> ''))) AS n_tokens
FROM items""")
def t20_token_set(spark, sf):
    toks = token_set(normalise_headline("master_headline"))
    return items(spark, sf).select("item_id", F.array_join(F.array_sort(toks), " ").alias("tokens"),
                                   F.size(toks).cast("long").alias("n_tokens"))
