"""Queries for verdicts, cluster verdicts/summaries, report rows, sovereignty filters, store and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gates
from ..operators import report as RP
from ..operators import sovereignty as SV
from ..operators import store as ST
from ..operators import text_ops as T
from ..operators import verdicts as VD
from ..session import scratch_path, written
from ..sources import sinks as SK
from ..sources import text_views as TV
from ..sources.fixtures import ITEMS_DUCK, items, with_ctes
from . import duck as D
from ..operators.cluster_jobs import exemplars
from .q_cluster import CLUSTERS_DUCK, _l2, clusters
from .q_funnel import _COUNTS_DUCK, _GATE_DUCK
from .registry import register

_VT_DUCK = """
vt AS (SELECT v_headline, min(v_ord) AS v_first, arg_max(verdict, v_ord) AS verdict, arg_max(reason, v_ord) AS reason
       FROM verdicts GROUP BY 1),
exact AS (SELECT i.item_id, vt.verdict, vt.reason FROM items i JOIN vt ON vt.v_headline = i.headline),
fuzzy AS (
  SELECT i.item_id, arg_min(vt.verdict, vt.v_first) AS verdict, arg_min(vt.reason, vt.v_first) AS reason
  FROM items i JOIN vt ON vt.v_headline <> '' AND (contains(i.headline, vt.v_headline) OR contains(vt.v_headline, i.headline))
  WHERE i.item_id NOT IN (SELECT item_id FROM exact) GROUP BY 1
),
matched AS (
  SELECT i.item_id, coalesce(m.verdict, 'NEEDS_REVIEW') AS kill_gate,
         CASE WHEN m.verdict IS NULL THEN 'No LLM verdict matched' ELSE coalesce(m.reason, '') END AS kill_gate_reason
  FROM items i LEFT JOIN (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy) m USING (item_id)
)"""

VCTE = with_ctes(ITEMS_DUCK, TV.VERDICTS_DUCK, _VT_DUCK)


def _matched(spark, sf):
    return VD.match_verdicts(items(spark, sf), TV.verdicts(spark, sf))


@register("j03_match_verdicts", VCTE + "SELECT item_id, kill_gate, kill_gate_reason FROM matched")
def j03_match_verdicts(spark, sf):
    return _matched(spark, sf).select("item_id", "kill_gate", "kill_gate_reason")


@register("g06_verdict_filter", VCTE + "SELECT item_id FROM matched WHERE kill_gate IN ('KEEP', 'NEEDS_REVIEW')")
def g06_verdict_filter(spark, sf):
    return VD.verdict_filter(_matched(spark, sf)).select("item_id")


@register("f01_scorer", with_ctes(ITEMS_DUCK) + """
SELECT item_id, headline AS v_headline,
  CASE WHEN coalesce(violation_count, 0) >= 2 OR contains(lower(concat_ws(' ', headline, short_description)), 'tion on')
       THEN 'KEEP' ELSE 'KILL' END AS verdict,
  CASE WHEN coalesce(violation_count, 0) >= 2 OR contains(lower(concat_ws(' ', headline, short_description)), 'tion on')
       THEN 'structural tension' ELSE 'no structural tension' END AS reason
FROM items""")
def f01_scorer(spark, sf):
    it = gates.quality_gate(gates.classify_tier(items(spark, sf), ["tion on"]))
    return VD.score_batches(it)


_CL_ITEMS = """
cl AS (
  SELECT c.*, CASE WHEN c.cluster_id = -1 THEN 0.0 ELSE (c.id % 8) / 8.0 END AS cluster_probability FROM clusters c
),
cv AS (
  SELECT cluster_id, count(*) >= 3 AS has_synthesis,
         CASE WHEN count(*) >= 3 THEN 'Cluster ' || CAST(cluster_id AS VARCHAR) || ': ' || coalesce(arg_min(headline, ord), '') ELSE '' END AS thesis
  FROM clusters WHERE cluster_id >= 0 GROUP BY 1
)"""


@register("j04_attach_cluster_verdicts", with_ctes(ITEMS_DUCK, CLUSTERS_DUCK, _CL_ITEMS) + """
SELECT c.id, CASE WHEN c.cluster_id < 0 THEN NULL ELSE coalesce(cv.has_synthesis, FALSE) END AS cluster_synthesis,
       CASE WHEN c.cluster_id < 0 THEN '' ELSE coalesce(cv.thesis, '') END AS cluster_thesis
FROM clusters c LEFT JOIN cv USING (cluster_id)""")
def j04_attach_cluster_verdicts(spark, sf):
    c = clusters(spark, sf)
    return VD.attach_cluster_verdicts(c, VD.cluster_verdicts(c)).select("id", "cluster_synthesis", "cluster_thesis")


_SUMMARY_D = f"""
dist AS (SELECT c.id, c.cluster_id, c.headline, c.ord, {_l2('c.v', 't.c')} AS d FROM clusters c JOIN cent t USING (cluster_id)),
reps AS (SELECT cluster_id, list(headline ORDER BY d, ord) AS rh FROM (
           SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d, ord) AS r FROM dist) WHERE r <= 3 GROUP BY 1),
summ AS (SELECT s.cluster_id, s.n AS size,
                array_to_string(list_transform(rh[1:2], lambda h: substr(coalesce(h, ''), 1, 50) || '...'), '; ') AS reps
         FROM csize s JOIN reps USING (cluster_id))"""


def _summaries(c):
    ex = exemplars(c, 3)
    reps = ex.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "headline"))).alias("_r"))
    sizes = c.filter(F.col("cluster_id") != -1).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(reps, "cluster_id").select("cluster_id", "size",
                                                 F.transform("_r", lambda s: s["headline"]).alias("rep_headlines"))


@register("j05_attach_cluster_summary", with_ctes(ITEMS_DUCK, CLUSTERS_DUCK, _SUMMARY_D) + """
SELECT c.id, CASE WHEN c.cluster_id = -1 THEN 1 ELSE coalesce(s.size, 1) END AS cluster_size,
       CASE WHEN c.cluster_id = -1 THEN '' ELSE coalesce(s.reps, '') END AS representative_items
FROM clusters c LEFT JOIN summ s USING (cluster_id)""")
def j05_attach_cluster_summary(spark, sf):
    c = clusters(spark, sf)
    a = VD.attach_cluster_summary(c, _summaries(c))
    return a.select("id", F.col("cluster_size").cast("long").alias("cluster_size"), "representative_items")


_REPORT_TIER = f"""
tiered AS (SELECT *, CASE WHEN {D.any_pattern("lower(concat_ws(' ', headline, short_description))", ['tion on'])} THEN 'CORE' ELSE 'ADJACENT' END AS relevance_tier FROM items)"""


@register("t23_report_row", with_ctes(ITEMS_DUCK, CLUSTERS_DUCK, _CL_ITEMS, _SUMMARY_D, TV.VERDICTS_DUCK, _VT_DUCK, _REPORT_TIER, _COUNTS_DUCK, _GATE_DUCK) + f"""
SELECT i.item_id,
  coalesce(i.master_headline, i.headline, 'N/A') AS story_master_headline, coalesce(i.headline, 'N/A') AS headline,
  coalesce(i.short_description, 'N/A') AS short_description, coalesce(i.source, 'N/A') AS source,
  coalesce(i.date, 'N/A') AS date, array_to_string(i.companies, ', ') AS companies,
  array_to_string(i.technologies, ', ') AS technologies, i.reality_status, i.reality_reason,
  CAST(i.violation_count AS VARCHAR) AS violation_count, array_to_string(i.top_violations, '; ') AS top_violations,
  array_to_string(i.minimal_repair, '; ') AS minimal_repairs, coalesce(i.region_us_raw, '') AS implication_us,
  coalesce(i.region_eu_raw, '') AS implication_eu, coalesce(i.region_cn_raw, '') AS implication_china,
  '' AS implication_rest_of_asia, coalesce(i.linkedin_angle, '') AS linkedin_angle,
  g.relevance_tier, g.quality_gate,
  CASE WHEN c.cluster_id = -1 THEN 'NOISE' ELSE CAST(c.cluster_id AS VARCHAR) END AS cluster_id,
  CAST(CASE WHEN c.cluster_id = -1 THEN 1 ELSE coalesce(s.size, 1) END AS VARCHAR) AS cluster_size,
  CASE WHEN c.cluster_id = -1 THEN 'Yes' ELSE 'No' END AS is_noise,
  printf('%.3f', c.cluster_probability) AS cluster_probability,
  CASE WHEN c.cluster_id = -1 THEN '' ELSE coalesce(s.reps, '') END AS representative_items,
  CASE WHEN c.cluster_id < 0 THEN 'N/A' WHEN coalesce(cv.has_synthesis, FALSE) THEN 'True' ELSE 'False' END AS cluster_synthesis,
  CASE WHEN c.cluster_id < 0 THEN '' ELSE coalesce(cv.thesis, '') END AS cluster_thesis,
  m.kill_gate, m.kill_gate_reason
FROM items i JOIN cl c ON c.id = i.item_id LEFT JOIN summ s ON s.cluster_id = c.cluster_id
LEFT JOIN cv ON cv.cluster_id = c.cluster_id JOIN matched m ON m.item_id = i.item_id JOIN gated g ON g.item_id = i.item_id""")
def t23_report_row(spark, sf):
    it = gates.quality_gate(gates.classify_tier(items(spark, sf), ["tion on"]))
    it = it.select("*", *T.flatten_violations(F.col("violations"))[1:], *T.flatten_regions(F.col("regional_implications")))
    c = clusters(spark, sf).select("id", "cluster_id", "embedding", "headline", "ord", "source")
    c = c.withColumn("cluster_probability", F.when(F.col("cluster_id") == -1, F.lit(0.0))
                     .otherwise((F.col("id") % 8) / 8.0)).withColumn("is_noise", F.col("cluster_id") == -1)
    enriched = VD.attach_cluster_summary(c, _summaries(c))
    enriched = VD.attach_cluster_verdicts(enriched, VD.cluster_verdicts(c))
    enriched = written(enriched.select(F.col("id").alias("item_id"), "cluster_id", "cluster_probability", "is_noise",
                                       "cluster_size", "representative_items", "cluster_synthesis", "cluster_thesis"), "clustered")
    # only items with a vector have a row: of the others neither text nor headline is shuffled, as long as the ids are few enough to send
    ids = enriched.select("item_id")
    kg = VD.match_verdicts(items(spark, sf).join(ids, "item_id", "left_semi"), TV.verdicts(spark, sf)).select("item_id", "kill_gate", "kill_gate_reason")
    # the narrow columns meet first, so the texts are shuffled once
    return RP.report_row(it.join(ids, "item_id", "left_semi").join(enriched.join(kg, "item_id"), "item_id"))


# ----------------------------------------------------------------------------
# sovereignty filters
# ----------------------------------------------------------------------------
_MODES_D = "modes AS (SELECT * FROM (VALUES ('strict', 0, 0.75), ('balanced', 1, 0.60), ('exploratory', 3, 0.40)) t(mode, max_violations, threshold))"
_MODE_OF = "CASE ord % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'balanced' ELSE 'exploratory' END"


@register("t26_threshold_for", with_ctes(ITEMS_DUCK, _MODES_D) + f"""
SELECT item_id, mode, CAST(threshold AS DOUBLE) AS threshold, max_violations FROM (SELECT item_id, {_MODE_OF} AS m FROM items) i
JOIN modes ON modes.mode = i.m""")
def t26_threshold_for(spark, sf):
    it = items(spark, sf).withColumn("mode", F.expr(_MODE_OF))
    return SV.threshold_for(it, SV.mode_table(spark)).select("item_id", "mode", "threshold", "max_violations")


@register("g07_threshold_filter", with_ctes(ITEMS_DUCK) + "SELECT item_id FROM items WHERE sovereignty_relevance_score / 10.0 >= 0.60")
def g07_threshold_filter(spark, sf):
    return SV.threshold_filter(items(spark, sf), SV.mode_table(spark), "balanced").select("item_id")


@register("g08_min_alignment", with_ctes(ITEMS_DUCK) + "SELECT item_id FROM items WHERE len(aligned_theses) >= 1")
def g08_min_alignment(spark, sf):
    return SV.min_alignment(items(spark, sf), 1).select("item_id")


@register("g09_max_violations", with_ctes(ITEMS_DUCK) + "SELECT item_id FROM items WHERE coalesce(violation_count, 0) <= 1")
def g09_max_violations(spark, sf):
    return SV.max_violations(items(spark, sf), SV.mode_table(spark), "balanced").select("item_id")


@register("g10_full_analysis_flag", with_ctes(ITEMS_DUCK) +
          "SELECT item_id, reality_status <> 'RUMOR' AS requires_full_analysis FROM items")
def g10_full_analysis_flag(spark, sf):
    return SV.full_analysis_flag(items(spark, sf), SV.status_table(spark)).select("item_id", "requires_full_analysis")


_THESES_D = ("theses AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {D.q(t)}, {D.q(c)})" for i, t, c in __import__("gleaner.params", fromlist=["THESES"]).THESES) +
    ") t(id, title, category))")
_RULES_D = ("rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {D.q(t)})" for i, t in __import__("gleaner.params", fromlist=["RULES"]).RULES) + ") t(id, title))")


@register("j10_rule_lookup", with_ctes(ITEMS_DUCK, _THESES_D, _RULES_D) + """
SELECT item_id, CAST(pos AS INTEGER) AS pos, thesis_id, theses.title, category,
       CAST(1 + item_id % 14 AS INTEGER) AS rule_id, rules.title AS rule_title FROM (
  SELECT item_id, generate_subscripts(aligned_theses, 1) - 1 AS pos, unnest(aligned_theses) AS thesis_id FROM items
  WHERE len(aligned_theses) > 0
  UNION ALL SELECT item_id, NULL, NULL FROM items WHERE len(aligned_theses) = 0) x
LEFT JOIN theses ON theses.id = x.thesis_id LEFT JOIN rules ON rules.id = 1 + item_id % 14""")
def j10_rule_lookup(spark, sf):
    d = SV.thesis_lookup(items(spark, sf), SV.thesis_table(spark))
    d = d.withColumn("rule_id", (1 + F.col("item_id") % 14).cast("int"))  # 13 and 14 are no rules
    return SV.rule_lookup(d, SV.rule_table(spark)).select(
        "item_id", "pos", "thesis_id", "title", "category", "rule_id", "rule_title")


# ----------------------------------------------------------------------------
# store
# ----------------------------------------------------------------------------
AS_OF_STORE = "2024-01-02 06:00:00"


def _store(spark, sf):
    return TV.store(spark, sf)


_STORE = with_ctes(TV.STORE_DUCK, f"""
fresh AS (SELECT * FROM store WHERE NOT (TIMESTAMP '{AS_OF_STORE}' > created_at + INTERVAL 24 HOUR))""", f"""
requests AS (SELECT doc_id, sha256('{TV.STORE_MODEL}' || ':' || text) AS key FROM documents)""")


@register("j08_cache_hits", _STORE + """
SELECT doc_id, key IN (SELECT key FROM fresh) AS hit FROM requests""")
def j08_cache_hits(spark, sf):
    from ..sources.tables import table
    req = table(spark, sf, "documents").select("doc_id", T.content_key(TV.STORE_MODEL, F.col("text")).alias("key"))
    return ST.cache_lookup(req, _store(spark, sf), AS_OF_STORE).select("doc_id", "hit")


@register("w09_evict_to_size", _STORE + """
, ordered AS (SELECT doc_id, size_bytes, sum(size_bytes) OVER (ORDER BY created_at, key ROWS UNBOUNDED PRECEDING) AS upto,
                     sum(size_bytes) OVER () AS total FROM store)
SELECT doc_id, total > 400000 AND total - (upto - size_bytes) > 0.8 * 400000 AS evicted FROM ordered""".replace(
    "\n, ordered AS", ",\nordered AS", 1))
def w09_evict_to_size(spark, sf):
    return ST.evict_to_size(_store(spark, sf), 400_000).select("doc_id", "evicted")


@register("a30_store_stats", _STORE + """
SELECT count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest,
       strftime(max(date_trunc('day', created_at)), '%Y-%m-%d %H:%M:%S') AS last_cleanup FROM store""")
def a30_store_stats(spark, sf):
    store = _store(spark, sf)
    # the store is cleaned at the start of every day that adds entries
    cleanups = store.select(F.date_trunc("day", "created_at").alias("cleaned_at"))
    s = ST.store_stats(store, cleanups)
    return s.select("entries", "total_bytes", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
                                                for c in ("newest", "last_cleanup")])


@register("s13_embedding_store", with_ctes(TV.STORE_DUCK) + """
SELECT model, count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM store GROUP BY 1""")
def s13_embedding_store(spark, sf):
    path = scratch_path(spark, "store")
    ST.write_store(TV.store(spark, sf), path, "overwrite")
    back = ST.read_store(spark, path, TV.STORE_MODEL)
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("total_bytes"))


# ----------------------------------------------------------------------------
# sinks
# ----------------------------------------------------------------------------
@register("s06_append_rows", with_ctes(ITEMS_DUCK) + """
SELECT item_id, headline, source FROM items UNION ALL SELECT item_id, headline, source FROM items WHERE violation_count >= 2""")
def s06_append_rows(spark, sf):
    path = scratch_path(spark, "report")
    it = items(spark, sf).select("item_id", "headline", "source", "violation_count")
    SK.append_rows(it.drop("violation_count"), path)
    SK.append_rows(it.filter(F.col("violation_count") >= 2).drop("violation_count"), path)
    return spark.read.parquet(path)


@register("s07_header_matches", "SELECT TRUE AS header_ok, FALSE AS needs_header, CAST(28 AS INTEGER) AS stored_columns, "
          "(SELECT count(*) FROM documents) AS rows_written")
def s07_header_matches(spark, sf):
    path = scratch_path(spark, "report28")
    it = items(spark, sf)
    rows = RP.report_row(it.select(
        "*", F.lit(-1).alias("cluster_id"), F.lit(None).cast("double").alias("cluster_probability"),
        F.lit(True).alias("is_noise"), F.lit(1).alias("cluster_size"), F.lit("").alias("representative_items"),
        F.lit(None).cast("boolean").alias("cluster_synthesis"), F.lit("").alias("cluster_thesis"))).drop("item_id")
    SK.append_rows(rows.toDF(*[h.strip() for h in RP.REPORT_COLUMNS]), path)
    chk = SK.header_matches(spark, path, [" " + c.upper() + " " for c in RP.REPORT_COLUMNS])
    n = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_written"))
    return chk.crossJoin(n)


@register("s08_append_synthesis", with_ctes(ITEMS_DUCK) + """
SELECT '2024-02-01' AS date, 'weekly' AS theme, string_agg(headline, ' | ' ORDER BY score DESC, ord) AS text, count(*) AS item_count
FROM (SELECT *, (CASE WHEN violation_count > 0 THEN 1 ELSE 0 END) AS score FROM items
      ORDER BY score DESC, ord LIMIT 5)""")
def s08_append_synthesis(spark, sf):
    path = scratch_path(spark, "synthesis")
    it = items(spark, sf).withColumn("score", F.when(F.col("violation_count") > 0, 1).otherwise(0))
    top = it.orderBy(F.col("score").desc(), "ord").limit(5)
    w = Window.orderBy(F.col("score").desc(), "ord")   # over the 5 chosen rows only
    row = (top.withColumn("_r", F.row_number().over(w))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "headline"))),
                                            lambda s: s["headline"]), " | ").alias("text"),
                   F.count(F.lit(1)).alias("item_count"))
              .select(F.lit("2024-02-01").alias("date"), F.lit("weekly").alias("theme"), "text", "item_count"))
    SK.append_synthesis(row, path)
    return spark.read.parquet(path)
