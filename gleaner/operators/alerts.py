"""Alerts: threshold rules, cooldown, duplicate suppression, lifecycle, statistics.

Input: ``alerts(alert_id, ts, alert_type, message, severity)`` and an action
log ``alert_actions(alert_id, action in {acknowledge, resolve}, action_ts)``.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured, written
from .metrics import since
from .series import prefix_agg, row_pieces


# ---------------------------------------------------------------------------
# M03 threshold rules
# ---------------------------------------------------------------------------
def threshold_alerts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Long metric rows ``(…, metric, value)`` ⋈ rules ``(metric, comparator, limit,
    alert_type, severity)``; strict comparisons, so a value equal to a limit
    raises nothing.  The rule table is tiny and broadcast."""
    j = values.join(F.broadcast(rules), "metric")
    cmp = F.col("comparator")
    hit = (F.when(cmp == ">", F.col("value") > F.col("limit"))
            .when(cmp == "<", F.col("value") < F.col("limit"))
            .when(cmp == ">=", F.col("value") >= F.col("limit"))
            .when(cmp == "<=", F.col("value") <= F.col("limit")))
    return j.filter(hit)


# ---------------------------------------------------------------------------
# M04 cooldown (batch): exact, parallel
# ---------------------------------------------------------------------------
def _next_pointer(al: DataFrame, cooldown_us: int) -> DataFrame:
    """For each alert: the first alert of the same type at or after ts + cooldown.

    Probes (ts + cooldown) and alerts are merged in one time order per type; a
    suffix minimum of (time, id) over alert rows answers every probe.  The
    suffix minimum is a two-level running aggregate, so no type's rows are
    gathered into a single task.
    """
    data = al.select("alert_type", F.col("_us").alias("_t"), F.lit(1).alias("_kind"),
                     F.struct(F.col("_us").alias("t"), F.col("alert_id").alias("id")).alias("_cand"),
                     F.lit(None).cast("long").alias("_probe_of"))
    probes = al.select("alert_type", (F.col("_us") + cooldown_us).alias("_t"), F.lit(0).alias("_kind"),
                       F.lit(None).cast("struct<t:bigint,id:bigint>").alias("_cand"),
                       F.col("alert_id").alias("_probe_of"))
    merged = data.unionByName(probes)
    suf = prefix_agg(merged, ["alert_type"], ["_t", "_kind", F.coalesce("_probe_of", "_cand.id")], None,
                     {"_next": ("min", "_cand")}, descending=True)
    return suf.filter(F.col("_kind") == 0).select(F.col("_probe_of").alias("alert_id"),
                                                  F.col("_next.id").alias("next_id"))


def alert_cooldown(al: DataFrame, minutes: int = 15) -> DataFrame:
    """Alerts that are sent under a per-type cooldown (suppressed while
    ts < last_sent + cooldown; equal passes; only a sent alert moves last_sent).

    The sent alerts of a type form the chain first → next(first) → … where
    next(i) is the first alert at or after ts_i + cooldown.  The chain is
    walked by pointer doubling: round k builds next^(2^k) by one self-join, and
    marking then adds next^(2^k)(m) for every marked m from the longest jump
    down.  Both phases take ⌈log₂ L⌉ joins for a chain of length L; every round
    is written to the shared checkpoint folder.
    """
    cd_us = minutes * 60 * 1_000_000
    a = al.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    # only pointers that lead somewhere: each round's table is shorter
    cur, seen = measured(_next_pointer(a, cd_us).filter(F.col("next_id").isNotNull()).withColumnRenamed("next_id", "j"), "jumps")
    jumps = []
    while seen["rows"]:
        jumps.append(cur)
        step = cur.join(cur.select(F.col("alert_id").alias("j"), F.col("j").alias("j2")), "j").select("alert_id", F.col("j2").alias("j"))
        cur, seen = measured(step, "jumps")
    first = (a.groupBy("alert_type").agg(F.min_by("alert_id", F.struct("_us", "alert_id")).alias("alert_id"))
             .select("alert_id"))
    marked = first
    for jmp in reversed(jumps):
        more = marked.join(jmp, "alert_id").select(F.col("j").alias("alert_id"))
        marked = written(marked.unionByName(more).distinct(), "sent")
    return al.join(marked, "alert_id", "left_semi")


# ---------------------------------------------------------------------------
# M05 cooldown + duplicate suppression (batch)
# ---------------------------------------------------------------------------
def alert_events(al: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Alerts (kind 1) and their resolutions (kind 0) as one time line
    ``(alert_id, alert_type, message, ts, kind)``; ``resolved`` is the part of the
    action log ``(alert_id, action_ts)`` that resolves."""
    cols = ("alert_id", "alert_type", "message", "ts", "kind")
    ev = al.withColumn("kind", F.lit(1)).select(*cols)
    if resolved is None:
        return ev
    done = resolved.groupBy("alert_id").agg(F.min("action_ts").alias("_done"))
    res = al.select("alert_id", "alert_type", "message").join(done, "alert_id").withColumn("kind", F.lit(0))
    return ev.unionByName(res.withColumnRenamed("_done", "ts").select(*cols))


def walk_alerts(events: pd.DataFrame, last: int | None, open_: dict[str, int], cooldown_us: int, dedup: bool):
    """One stretch of a type's time line in order: (sent alert ids, last sent time, open messages)."""
    sent = []
    for aid, msg, us, kind in zip(events["alert_id"], events["message"], events["us"], events["kind"]):
        if kind == 0:
            if open_.get(msg) == aid:
                del open_[msg]
        elif (last is None or us >= last + cooldown_us) and not (dedup and msg in open_):
            sent.append(int(aid))
            last = int(us)
            if dedup:
                open_[msg] = int(aid)
    return sent, last, open_


def alert_dedup(al: DataFrame, minutes: int = 15, resolved: DataFrame | None = None) -> DataFrame:
    """Cooldown plus "no second alert while an unresolved one has the same type and
    message"; a resolution at or before an alert's time frees its message.

    What is sent depends on everything sent before, so a type is walked in order,
    in stretches of bounded row count (``row_pieces``): round r walks the r-th
    stretch of every type in parallel and hands on one state row per type.
    """
    cd_us = minutes * 60 * 1_000_000
    ev = alert_events(al, resolved).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    order = ["us", "kind", "alert_id"]
    pieces = row_pieces(ev, ["alert_type"], order)
    rounds = written(pieces.select("alert_type", "_piece").distinct().withColumn(
        "_round", F.row_number().over(Window.partitionBy("alert_type").orderBy("_piece"))), "rounds")
    last_round = rounds.agg(F.max("_round")).first()[0] or 0
    spark = al.sparkSession
    state_schema = "alert_type string, alert_id long, last_us long, open map<string,long>"
    state = spark.createDataFrame([], state_schema)

    def stretch(events: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if events.empty:
            return before
        last, open_ = None, {}
        if len(before):
            last = None if pd.isna(before["last_us"].iloc[0]) else int(before["last_us"].iloc[0])
            open_ = dict(before["open"].iloc[0] or {})
        sent, last, open_ = walk_alerts(events.sort_values(order, kind="mergesort"), last, open_, cd_us, True)
        kind = events["alert_type"].iloc[0]
        rows = [(kind, aid, None, None) for aid in sent] + [(kind, None, last, open_)]
        out = pd.DataFrame(rows, columns=["alert_type", "alert_id", "last_us", "open"])
        return out.astype({"alert_id": "Int64", "last_us": "Int64"})

    sent = []
    for r in range(1, last_round + 1):
        part = pieces.join(rounds.filter(F.col("_round") == r), ["alert_type", "_piece"])
        out = written(part.groupBy("alert_type").cogroup(state.groupBy("alert_type")).applyInPandas(stretch, state_schema), "walk")
        sent.append(out.filter(F.col("alert_id").isNotNull()).select("alert_id"))
        state = out.filter(F.col("alert_id").isNull())
    if not sent:
        return al.limit(0)
    return al.join(functools.reduce(DataFrame.unionByName, sent), "alert_id", "left_semi")


# ---------------------------------------------------------------------------
# M06 lifecycle, M07 purge
# ---------------------------------------------------------------------------
def alert_lifecycle(al: DataFrame, actions: DataFrame, as_of=None) -> DataFrame:
    """Open → acknowledged → resolved from the action log (actions after ``as_of`` ignored)."""
    act = actions if as_of is None else actions.filter(F.col("action_ts") <= as_of)
    st = act.groupBy("alert_id").agg(
        F.min(F.when(F.col("action") == "acknowledge", F.col("action_ts"))).alias("acknowledged_at"),
        F.min(F.when(F.col("action") == "resolve", F.col("action_ts"))).alias("resolved_at"))
    return al.join(st, "alert_id", "left").withColumn(
        "state", F.when(F.col("resolved_at").isNotNull(), "resolved")
                  .when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("open"))


def purge_resolved(life: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Keep unresolved alerts and alerts newer than the cutoff."""
    return life.filter((F.col("state") != "resolved") |
                       (F.col("ts") >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")))


# ---------------------------------------------------------------------------
# M08 severity, A21 statistics, K05 top types, M29 incident report
# ---------------------------------------------------------------------------
def severity(source: Column, message: Column) -> Column:
    """Severity from the alert source and message text."""
    m = F.lower(message)
    return (F.when(source == "performance", F.when(F.instr(m, "exceeded") > 0, "critical").otherwise("warning"))
             .when(source == "quality", F.when(F.instr(m, "low") > 0, "warning").otherwise("info"))
             .when(source == "health", F.when(F.instr(m, "unhealthy") > 0, "critical").otherwise("warning"))
             .otherwise("info"))


def alert_statistics(al: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Totals, by severity and by type within the window, as (dimension, key, alerts)."""
    r = since(al, as_of, hours=hours)
    total = r.agg(F.count(F.lit(1)).alias("alerts")).select(F.lit("total").alias("dimension"),
                                                            F.lit("all").alias("key"), "alerts")
    sev = r.groupBy(F.col("severity").alias("key")).agg(F.count(F.lit(1)).alias("alerts")).select(
        F.lit("severity").alias("dimension"), "key", "alerts")
    typ = r.groupBy(F.col("alert_type").alias("key")).agg(F.count(F.lit(1)).alias("alerts")).select(
        F.lit("type").alias("dimension"), "key", "alerts")
    return total.unionByName(sev).unionByName(typ)


def top_alert_types(al: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent types (ties: first seen first)."""
    g = al.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"),
                                     F.min(F.struct("ts", "alert_id")).alias("_first"))
    return g.orderBy(F.col("alerts").desc(), F.col("_first").asc()).limit(n).drop("_first")


def incident_report(life: DataFrame) -> DataFrame:
    """Mean time to acknowledge ("detect") and to resolve ("recover") in
    minutes, incidents by category, and the share resolved without an
    acknowledgement (read as false positives)."""
    mins = lambda a, b: (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 6e7
    return life.groupBy("alert_type").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.avg(mins("acknowledged_at", "ts")).alias("mean_minutes_to_detect"),
        F.avg(mins("resolved_at", "ts")).alias("mean_minutes_to_recover"),
        (F.count_if(F.col("resolved_at").isNotNull() & F.col("acknowledged_at").isNull())
         / F.count(F.lit(1))).alias("false_positive_share"))
