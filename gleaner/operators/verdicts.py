"""Verdicts: scorer plug points, headline matching, cluster verdicts and summaries.

``match_verdicts`` (J03) first joins on the exact headline; the rest fall back
to "the first verdict, in insertion order, whose headline contains or is
contained in the item's headline".  That fallback is a theta join, computed
exactly without a nested loop by ``contained_pairs``: every string that could
be contained probes with its rarest gram, of up to 12 characters as its length
allows, the containing side is indexed by its grams of those lengths, and
candidates are verified with ``instr``.  Different headlines are looked up once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..session import written

#: Gram lengths: a contained string probes with grams of the greatest length that it has room for.
GRAMS = (1, 2, 3, 6, 12)


def contained_pairs(outer: DataFrame, inner: DataFrame, o_id: str, o_txt: str, i_id: str, i_txt: str,
                    grams: Sequence[int] = GRAMS) -> DataFrame:
    """All (outer id, inner id) with the inner string a substring of the outer string.

    Exact for every inner string of at least ``grams[0]`` characters.  Empty inner
    strings (inside everything) are left to the caller, which needs only an aggregate
    over all outers.
    """
    o = outer.select(F.col(o_id).alias("oid"), F.col(o_txt).alias("ot")).filter(F.col("ot").isNotNull())
    i = inner.select(F.col(i_id).alias("iid"), F.col(i_txt).alias("it")).filter(F.length("it") >= grams[0])
    # only ids and hashed grams are shuffled; the texts come back for the check
    return (contained_candidates(o, i, grams).join(o, "oid").join(i, "iid")
            .filter(F.instr("ot", F.col("it")) > 0).select("oid", "iid").distinct())


def contained_candidates(o: DataFrame, i: DataFrame, grams: Sequence[int] = GRAMS) -> DataFrame:
    """(oid, iid) of every outer string (oid, ot) that has the rarest g-gram of an inner
    string (iid, it), g the greatest of ``grams`` that is no more than its length.  The
    outer strings are indexed only by the gram lengths that some inner string uses."""
    g = F.lit(grams[0])
    for x in grams[1:]:
        g = F.when(F.length("it") >= x, F.lit(x)).otherwise(g)
    i = i.withColumn("g", g)
    if len(grams) == 1:
        og = o.select("oid", F.explode(_grams("ot", grams[0])).alias("gram"))
    else:
        used = i.agg(F.collect_set("g").alias("used"))  # one row
        none = F.array().cast("array<bigint>")
        og = o.crossJoin(F.broadcast(used)).select("oid", F.explode(F.concat(
            *(F.when(F.array_contains("used", x), _grams("ot", x)).otherwise(none) for x in grams))).alias("gram"))
    freq = og.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    mine = _grams("it", grams[0])
    for x in grams[1:]:
        mine = F.when(F.col("g") == x, _grams("it", x)).otherwise(mine)
    ig = i.select("iid", F.explode(mine).alias("gram"))
    probe = (ig.join(freq, "gram", "left").withColumn("f", F.coalesce("f", F.lit(0)))
               .groupBy("iid").agg(F.min_by("gram", F.struct("f", "gram")).alias("gram"), F.min("f").alias("f")))
    # an inner string with a gram that no outer string has is inside nothing
    return probe.filter(F.col("f") > 0).join(og, "gram").select("oid", "iid").distinct()


def _grams(text: str, g: int):
    """Hashes of the distinct g-character substrings (an equal hash is only a candidate)."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - g + 1, F.lit(1)))
    grams = F.filter(F.transform(at, lambda p: F.substring(F.col(text), p, F.lit(g))), lambda x: F.length(x) == g)
    return F.transform(F.array_distinct(grams), lambda x: F.xxhash64(x))


def verdict_table(raw: DataFrame) -> DataFrame:
    """Per headline: the last verdict written (value) at its first insertion (order)."""
    return raw.filter(F.col("v_headline").isNotNull()).groupBy("v_headline").agg(
        F.min("v_ord").alias("v_first"),
        F.max_by(F.struct("verdict", "reason"), "v_ord").alias("v"))


def match_verdicts(items: DataFrame, raw_verdicts: DataFrame) -> DataFrame:
    """``kill_gate`` and ``kill_gate_reason`` per item (NEEDS_REVIEW when nothing matches)."""
    heads = written(items.select("item_id", "headline"), "headlines")
    # headlines and verdict keys travel as their first place and a hash
    vt = written(verdict_table(raw_verdicts).withColumn("vid", F.struct("v_first", F.xxhash64("v_headline").alias("h"))), "verdicts")
    exact = heads.join(vt, heads.headline == vt.v_headline, "inner").select(
        "item_id", F.col("v.verdict").alias("verdict"), F.col("v.reason").alias("reason"))
    rest = written(heads.join(exact.select("item_id"), "item_id", "left_anti"), "headlines")
    vk = vt.filter((F.col("v_headline") != "") & F.col("v_first").isNotNull())
    # each different headline is looked up once
    keys = written(rest.filter(F.col("headline") != "").groupBy("headline").agg(F.min("item_id").alias("first")).select(
        "headline", F.struct("first", F.xxhash64("headline").alias("h")).alias("hid")), "headlines")
    a = contained_pairs(keys, vk, "hid", "headline", "vid", "v_headline")      # vk inside headline
    b = contained_pairs(vk, keys, "vid", "v_headline", "hid", "headline")      # headline inside vk
    best = a.select(F.col("oid").alias("hid"), F.col("iid").alias("vid")).unionByName(
        b.select(F.col("iid").alias("hid"), F.col("oid").alias("vid"))).groupBy("hid").agg(F.min("vid").alias("vid"))
    fuzzy = (rest.join(keys.join(best, "hid").select("headline", "vid"), "headline").groupBy("item_id").agg(F.min("vid").alias("vid"))
             .join(vt, "vid").select("item_id", F.col("v.verdict").alias("verdict"), F.col("v.reason").alias("reason")))
    # an empty headline is inside every verdict key: it takes the first verdict (one row)
    first = vk.agg(F.min_by("v", "v_first").alias("v")).select(
        F.col("v.verdict").alias("verdict"), F.col("v.reason").alias("reason"))
    blank = rest.filter(F.col("headline") == "").select("item_id").crossJoin(F.broadcast(first)).filter(
        F.col("verdict").isNotNull())
    got = exact.unionByName(fuzzy).unionByName(blank)
    out = items.join(got, "item_id", "left")
    return (out.withColumn("kill_gate", F.coalesce(F.col("verdict"), F.lit("NEEDS_REVIEW")))
               .withColumn("kill_gate_reason", F.when(F.col("verdict").isNull(), F.lit(P.MSG_NO_VERDICT))
                           .otherwise(F.coalesce(F.col("reason"), F.lit(""))))
               .drop("verdict", "reason"))


def verdict_filter(df: DataFrame) -> DataFrame:
    """Keep KEEP and NEEDS_REVIEW."""
    return df.filter(F.col("kill_gate").isin("KEEP", "NEEDS_REVIEW"))


# ---------------------------------------------------------------------------
# F01 scorer plug point
# ---------------------------------------------------------------------------
VERDICT_SCHEMA = "item_id long, v_headline string, verdict string, reason string"


def rule_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """Default deterministic scorer: KEEP with two or more violations or a CORE tier."""
    keep = (batch["violation_count"].fillna(0) >= 2) | (batch["relevance_tier"] == "CORE")
    return pd.DataFrame({"item_id": batch["item_id"], "v_headline": batch["headline"],
                         "verdict": keep.map({True: "KEEP", False: "KILL"}),
                         "reason": keep.map({True: "structural tension", False: "no structural tension"})})


def score_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] = rule_scorer,
                  batch_size: int = 5) -> DataFrame:
    """run ``scorer`` on batches of ``batch_size`` rows (``mapInPandas``); a batch that
    raises is retried row by row, and a row that still fails gets NEEDS_REVIEW."""
    def run(it):
        for pdf in it:
            for s in range(0, len(pdf), batch_size):
                b = pdf.iloc[s:s + batch_size]
                try:
                    yield scorer(b)
                except Exception:  # noqa: BLE001 — a scorer is user code
                    for r in range(len(b)):
                        row = b.iloc[r:r + 1]
                        try:
                            yield scorer(row)
                        except Exception:  # noqa: BLE001
                            yield pd.DataFrame({"item_id": row["item_id"], "v_headline": row["headline"],
                                                "verdict": ["NEEDS_REVIEW"], "reason": ["scorer failed"]})
    cols = df.select("item_id", "headline", "violation_count", "relevance_tier")
    return cols.mapInPandas(run, VERDICT_SCHEMA)


# ---------------------------------------------------------------------------
# J04 / J05 cluster verdicts and summaries
# ---------------------------------------------------------------------------
def cluster_verdicts(assigned: DataFrame, min_items: int = 3) -> DataFrame:
    """Default cluster judge: a synthesis needs ``min_items`` rows; singletons get
    'Single-item cluster'.  One row per cluster."""
    g = assigned.filter(F.col("cluster_id") >= 0).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("headline", "ord").alias("first_headline"))
    return g.select(
        "cluster_id",
        (F.col("n") >= min_items).alias("has_synthesis"),
        F.when(F.col("n") >= min_items, F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(": "),
                                                  F.coalesce("first_headline", F.lit(""))))
         .otherwise(F.lit("")).alias("thesis"),
        F.when(F.col("n") < 2, F.lit("Single-item cluster")).otherwise(F.lit("")).alias("reason"))


def attach_cluster_verdicts(assigned: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items ⟕ cluster verdicts; noise rows get null synthesis and '' thesis.

    The verdict table has one row per cluster; the join is left to AQE, which
    broadcasts it when its measured size is small."""
    j = assigned.join(verdicts.select("cluster_id", "has_synthesis", "thesis"), "cluster_id", "left")
    noise = F.col("cluster_id") < 0
    return j.withColumn("cluster_synthesis", F.when(noise, F.lit(None).cast("boolean"))
                        .otherwise(F.coalesce(F.col("has_synthesis"), F.lit(False)))) \
            .withColumn("cluster_thesis", F.when(noise, F.lit("")).otherwise(F.coalesce(F.col("thesis"), F.lit("")))) \
            .drop("has_synthesis", "thesis")


def attach_cluster_summary(assigned: DataFrame, summaries: DataFrame) -> DataFrame:
    """Size (default 1) and the first two representative headlines (50 chars + '...')."""
    reps = F.array_join(F.transform(F.slice(F.col("rep_headlines"), 1, 2),
                                    lambda h: F.concat(F.substring(F.coalesce(h, F.lit("")), 1, 50), F.lit("..."))), "; ")
    s = summaries.select("cluster_id", F.col("size").alias("_size"), reps.alias("_reps"))
    j = assigned.join(s, "cluster_id", "left")
    noise = F.col("cluster_id") == -1
    return j.withColumn("cluster_size", F.when(noise, F.lit(1)).otherwise(F.coalesce("_size", F.lit(1)))) \
            .withColumn("representative_items", F.when(noise, F.lit("")).otherwise(F.coalesce("_reps", F.lit("")))) \
            .drop("_size", "_reps")
