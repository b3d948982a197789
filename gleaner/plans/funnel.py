"""The digest funnel as one lazy plan: items → gates → scored top-N.

Every stage is a narrow projection or filter except the final top-N, which is
a per-partition top-k plus one small merge (TakeOrderedAndProject).  The
stage order puts the cheap rule gates before anything that calls out of the
JVM (verdict scorers), because Catalyst will not move a filter below a Python
function on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..operators import gates


def rule_funnel(items: DataFrame,
                core_patterns: Sequence[str] = P.CORE_PATTERNS,
                shopping_words: Sequence[str] = P.SHOPPING_WORDS,
                cap: int = P.HARD_CAP) -> DataFrame:
    """Tier → quality gate → pre-kill → hard cap (the rule-only funnel).

    The gate outcome is folded into the top-k sort key (rejected rows sort
    last) and rows are dropped only after the limit, on at most cap+1 rows.
    A filter on the labelled frame would instead have Catalyst inline every
    gate expression into the scan-side predicate, evaluated without common
    subexpression elimination.
    """
    flags = stage_flags(items, core_patterns, shopping_words)
    scored = gates.item_score(flags)
    keyed = scored.withColumn("score_tenths",
                              F.when(F.col("passed_pre_kill"), F.col("score_tenths")))
    return (gates.hard_cap(keyed, cap, alive="passed_pre_kill")
            .drop("passed_quality", "passed_pre_kill"))


def stage_flags(items: DataFrame,
                core_patterns: Sequence[str] = P.CORE_PATTERNS,
                shopping_words: Sequence[str] = P.SHOPPING_WORDS) -> DataFrame:
    """All rule stages evaluated on every row, for funnel counts and rejects."""
    tiered = gates.classify_tier(items, core_patterns)
    gated = gates.quality_gate(tiered)
    killed = gates.pre_kill(gated, shopping_words, core_patterns)
    return killed.withColumn(
        "passed_quality", F.col("quality_gate").isin("PASS", "NO_DATA")
    ).withColumn(
        "passed_pre_kill", F.col("passed_quality") & F.coalesce(F.col("kill_gate") != "PRE_KILL", F.lit(True)))
