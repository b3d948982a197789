"""Rule gates of the digest funnel: tiering, quality gate, pre-kill, scoring, caps.

Every gate is a narrow projection (no shuffle); word lists and limits are
parameters.  Gates label rows instead of dropping them, so ``kept`` and
``rejected`` are two filters over one labelled frame and kept ∪ rejected is
always the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import any_pattern, any_substring, joined_lower


# ---------------------------------------------------------------------------
# G01 relevance tier
# ---------------------------------------------------------------------------
def classify_tier(df: DataFrame, patterns: Sequence[str] = P.CORE_PATTERNS) -> DataFrame:
    """CORE when any pattern hits lower(headline + ' ' + short_description)."""
    text = joined_lower("headline", "short_description")
    return df.withColumn(
        "relevance_tier", F.when(any_pattern(text, patterns), F.lit("CORE")).otherwise(F.lit("ADJACENT")))


# ---------------------------------------------------------------------------
# A01 judgment counts
# ---------------------------------------------------------------------------
def _count_judgment(judgment: str, min_reason: int | None = None) -> Column:
    arr = F.coalesce(F.col("axiom_check"), F.array().cast("array<struct<axiom_id:int,judgment:string,reason:string>>"))
    if min_reason is None:
        pred = lambda x: x["judgment"] == judgment
    else:
        pred = lambda x: (x["judgment"] == judgment) & (F.length(x["reason"]) > min_reason)
    return F.size(F.filter(arr, pred))


def judgment_counts(df: DataFrame, min_reason: int = P.ALIGNED_REASON_MIN) -> DataFrame:
    """Per item: ALIGNED with a reason longer than ``min_reason``, TENSION, VIOLATION, N/A."""
    return (df
            .withColumn("aligned_count", _count_judgment("ALIGNED", min_reason))
            .withColumn("tension_count", _count_judgment("TENSION"))
            .withColumn("violation_judgments", _count_judgment("VIOLATION"))
            .withColumn("na_count", _count_judgment("N/A")))


def _has_items(c: str) -> Column:
    return F.coalesce(F.size(F.col(c)) > 0, F.lit(False))


# ---------------------------------------------------------------------------
# G02 quality gate
# ---------------------------------------------------------------------------
def quality_gate(df: DataFrame, angle_min: int = P.ANGLE_MIN) -> DataFrame:
    """Label every row PASS / FAIL / NO_DATA with all reject reasons.

    Needs ``relevance_tier`` (defaults to ADJACENT) and adds the A01 counts.
    """
    if "aligned_count" not in df.columns:
        df = judgment_counts(df)
    if "relevance_tier" not in df.columns:
        df = df.withColumn("relevance_tier", F.lit("ADJACENT"))
    tier = F.coalesce(F.col("relevance_tier"), F.lit("ADJACENT"))
    status = F.coalesce(F.col("reality_status"), F.lit(""))
    vc = F.coalesce(F.col("violation_count"), F.lit(0))
    angle = F.coalesce(F.col("linkedin_angle"), F.lit(""))
    aligned, tension, viol = F.col("aligned_count"), F.col("tension_count"), F.col("violation_judgments")
    core = tier == "CORE"
    reasons = F.array_compact(F.array(
        F.when(status.isin("OPINION", "ANALYSIS") & (vc == 0),
               F.concat(status, F.lit(P.MSG_STATUS_NO_VIOLATIONS.replace("{status}", "")))),
        F.when(angle == "GENERIC_ANGLE", F.lit(P.MSG_GENERIC_ANGLE))
         .when(F.length(angle) < angle_min,
               F.format_string(P.MSG_WEAK_ANGLE.replace("{n}", "%d"), F.length(angle))),
        F.when(core & ~((aligned >= 3) | ((tension + viol) >= 1)),
               F.format_string(P.MSG_CORE_WEAK.replace("{aligned}", "%d").replace("{tv}", "%d"),
                               aligned, tension + viol)),
        F.when(core & (viol == 0) & (tension == 0), F.lit(P.MSG_CORE_BLAND)),
        F.when(~core & (viol < 1),
               F.format_string(P.MSG_ADJ_NO_VIOLATIONS.replace("{tensions}", "%d"), tension)),
        F.when(~core & ~_has_items("companies") & ~_has_items("technologies"), F.lit(P.MSG_ADJ_NO_SUBSTANCE)),
    ))
    no_data = ~_has_items("axiom_check")
    pass_detail = F.format_string(
        P.MSG_PASS_DETAIL.replace("{tier}", "%s").replace("{aligned}", "%d").replace("{tensions}", "%d")
        .replace("{violations}", "%d").replace("{angle_len}", "%d"),
        tier, aligned, tension, viol, F.length(angle))
    return (df
            .withColumn("_reasons", reasons)
            .withColumn("quality_gate",
                        F.when(no_data, "NO_DATA").when(F.size("_reasons") == 0, "PASS").otherwise("FAIL"))
            .withColumn("quality_gate_detail",
                        F.when(no_data, F.lit(None).cast("string"))
                         .when(F.size("_reasons") == 0, pass_detail)
                         .otherwise(F.array_join("_reasons", "; ")))
            .drop("_reasons"))


def quality_kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("quality_gate").isin("PASS", "NO_DATA"))


# ---------------------------------------------------------------------------
# G04 keyword test, G03 pre-kill
# ---------------------------------------------------------------------------
def searchable_text() -> Column:
    """lower(headline + ' ' + description + ' ' + technologies joined by ' ')."""
    techs = F.array_join(F.coalesce(F.col("technologies"), F.array().cast("array<string>")), " ")
    return joined_lower("headline", "short_description", techs)


def keyword_any(df: DataFrame, words: Sequence[str] = P.SHOPPING_WORDS, out: str = "has_keyword") -> DataFrame:
    """Any word as a substring of the searchable text."""
    return df.withColumn(out, any_substring(searchable_text(), words))


def pre_kill(df: DataFrame, shopping_words: Sequence[str] = P.SHOPPING_WORDS,
             core_patterns: Sequence[str] = P.CORE_PATTERNS) -> DataFrame:
    """Label rows PRE_KILL (two tiers, the first hit names the reason); others keep null."""
    text = searchable_text()
    vc = F.coalesce(F.col("violation_count"), F.lit(0))
    tier = F.coalesce(F.col("relevance_tier"), F.lit("ADJACENT"))
    status = F.coalesce(F.col("reality_status"), F.lit(""))
    t1 = (vc == 0) & (tier == "ADJACENT") & ~any_substring(text, shopping_words)
    t2 = (vc == 0) & status.isin("REPORTED", "OPINION") & ~any_pattern(text, core_patterns)
    return (df
            .withColumn("kill_gate", F.when(t1 | t2, F.lit("PRE_KILL")).otherwise(F.col("kill_gate"))
                        if "kill_gate" in df.columns else F.when(t1 | t2, F.lit("PRE_KILL")))
            .withColumn("kill_gate_reason",
                        F.when(t1, F.lit(P.MSG_PREKILL_T1))
                         .when(t2, F.format_string(P.MSG_PREKILL_T2.replace("{status}", "%s"), status))
                         .otherwise(F.col("kill_gate_reason") if "kill_gate_reason" in df.columns
                                    else F.lit(None).cast("string"))))


def pre_kill_kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("kill_gate").isNull() | (F.col("kill_gate") != "PRE_KILL"))


# ---------------------------------------------------------------------------
# K01 item score, K02 hard cap, K03 synthesis top
# ---------------------------------------------------------------------------
def item_score(df: DataFrame) -> DataFrame:
    """``score`` (double) and ``score_tenths`` (exact)."""
    w = P.SCORE_TENTHS
    if "relevance_tier" not in df.columns:
        df = df.withColumn("relevance_tier", F.lit("ADJACENT"))
    keep = (F.when(F.col("kill_gate") == "KEEP", w["keep"]).otherwise(0)
            if "kill_gate" in df.columns else F.lit(0))
    arr = F.coalesce(F.col("axiom_check"), F.array().cast("array<struct<axiom_id:int,judgment:string,reason:string>>"))
    viol = F.size(F.filter(arr, lambda x: x["judgment"] == "VIOLATION"))
    tens = F.size(F.filter(arr, lambda x: x["judgment"] == "TENSION"))
    status = F.coalesce(F.col("reality_status"), F.lit(""))
    angle = F.coalesce(F.col("linkedin_angle"), F.lit(""))
    real_angle = (angle != "") & (angle != "GENERIC_ANGLE")
    tenths = (F.when(F.col("relevance_tier") == "CORE", w["core"]).otherwise(0)
              + viol * w["violation"] + tens * w["tension"]
              + F.when(status == "CONFIRMED", w["CONFIRMED"]).when(status == "REPORTED", w["REPORTED"])
                 .when(status == "ANALYSIS", w["ANALYSIS"]).otherwise(0)
              + F.when(real_angle & (F.length(angle) > 150), w["angle_gt_150"])
                 .when(real_angle & (F.length(angle) > 100), w["angle_gt_100"]).otherwise(0)
              + F.when(_has_items("companies"), w["companies"]).otherwise(0)
              + keep)
    return (df.withColumn("score_tenths", tenths.cast("long"))
              .withColumn("score", F.col("score_tenths") / F.lit(10.0)))


def top_by_score(df: DataFrame, n: int) -> DataFrame:
    """Top ``n`` by (score desc, ord): a per-partition top-k then one small merge."""
    if "score_tenths" not in df.columns:
        df = item_score(df)
    return df.orderBy(F.col("score_tenths").desc_nulls_last(), F.col("ord").asc()).limit(n)


def hard_cap(df: DataFrame, n: int = P.HARD_CAP, alive: str | None = None) -> DataFrame:
    """Unchanged when at most ``n`` rows; else the top ``n`` with ``hard_cap_score``.

    Only the top n+1 rows are ever brought together (TakeOrderedAndProject);
    whether the cap applies is read from that small frame, not from a global
    count over the input.  With ``alive`` (a boolean column) rows where it is
    false must carry a null ``score_tenths``: they sort last and are dropped
    after the limit.
    """
    scored = df if "score_tenths" in df.columns else item_score(df)
    head = top_by_score(scored, n + 1)
    if alive is not None:
        head = head.filter(F.col(alive))
    # head has at most n+1 rows; when it has n or fewer it is the whole input
    w = Window.orderBy(F.col("score_tenths").desc(), F.col("ord").asc())
    return (head.withColumn("_rank", F.row_number().over(w))
                .withColumn("_capped", F.max("_rank").over(Window.partitionBy()) > n)
                .filter(F.col("_rank") <= n)
                .withColumn("hard_cap_score",
                            F.when(F.col("_capped"), F.round(F.col("score"), 2)).otherwise(F.lit(None).cast("double")))
                .drop("_rank", "_capped"))


def top_for_synthesis(df: DataFrame, n: int = P.SYNTHESIS_TOP) -> DataFrame:
    """Top ``n`` by score (input order on ties) with the rounded score."""
    return top_by_score(df, n).withColumn("write_priority_score", F.round(F.col("score"), 2))
