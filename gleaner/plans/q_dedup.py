"""Queries for story dedup: keys, similar pairs, leader election, best rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import token_set
from ..operators import dedup as DD
from ..session import written
from ..sources.fixtures import ITEMS_DUCK, items, with_ctes
from . import duck as D
from .registry import register

_GEN = "[" + ", ".join(D.q(g) for g in P.GENERIC_WORDS) + "]"
_K1 = D.normalise_headline("coalesce(master_headline, headline, '')")
_K2 = D.normalise_headline("coalesce(headline, 'unknown')")

KEYS_DUCK = f"""
keyed AS (
  SELECT item_id, ord, axiom_check, violation_count,
         CASE WHEN {_K1} = '' THEN {_K2} ELSE {_K1} END AS story_key FROM items
),
keys AS (
  SELECT story_key, min(ord) AS key_ord,
         list_distinct(list_filter(str_split(story_key, ' '), lambda w: w <> '')) AS toks
  FROM keyed GROUP BY 1
),
jac AS (
  SELECT a.key_ord AS a, b.key_ord AS b,
         len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) AS jaccard
  FROM keys a JOIN keys b ON a.key_ord < b.key_ord
  WHERE len(a.toks) > 0 AND len(b.toks) > 0
    AND len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.4
    AND len(list_filter(list_intersect(a.toks, b.toks), lambda w: NOT list_contains({_GEN}, w))) >= 1
),
cont AS (
  SELECT a.key_ord AS a, b.key_ord AS b FROM keys a JOIN keys b ON a.key_ord < b.key_ord
  WHERE length(a.story_key) > 10 AND length(b.story_key) > 10
    AND (contains(a.story_key, b.story_key) OR contains(b.story_key, a.story_key))
),
edges AS (SELECT a, b FROM jac UNION SELECT a, b FROM cont)"""

MIS_DUCK = """
ordered AS (SELECT key_ord, row_number() OVER (ORDER BY key_ord) AS i FROM keys),
nb AS (SELECT o.i, list(e.a) AS earlier FROM edges e JOIN ordered o ON o.key_ord = e.b GROUP BY 1),
steps AS (SELECT o.i, o.key_ord, coalesce(nb.earlier, []) AS earlier FROM ordered o LEFT JOIN nb USING (i)),
walk(i, surv) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.i + 1, CASE WHEN len(list_intersect(s.earlier, w.surv)) > 0 THEN w.surv
                       ELSE list_append(w.surv, s.key_ord) END
  FROM walk w JOIN steps s ON s.i = w.i + 1
),
leaders AS (SELECT unnest(surv) AS key_ord FROM walk WHERE i = (SELECT count(*) FROM ordered)),
lead_of AS (
  SELECT k.key_ord, CASE WHEN k.key_ord IN (SELECT key_ord FROM leaders) THEN k.key_ord
         ELSE (SELECT min(e.a) FROM edges e WHERE e.b = k.key_ord AND e.a IN (SELECT key_ord FROM leaders)) END AS leader_ord
  FROM keys k
),
grp AS (
  SELECT kd.item_id, kd.ord, k.key_ord, l.leader_ord, coalesce(kd.violation_count, 0) AS vc,
         len(list_filter(coalesce(kd.axiom_check, []), lambda x: x.judgment = 'TENSION')) AS tc
  FROM keyed kd JOIN keys k USING (story_key) JOIN lead_of l USING (key_ord)
),
best AS (
  SELECT leader_ord, item_id, count(*) OVER (PARTITION BY leader_ord) AS group_rows,
         row_number() OVER (PARTITION BY leader_ord ORDER BY vc DESC, tc DESC, key_ord, ord) AS r
  FROM grp
)"""

CTE = with_ctes(ITEMS_DUCK, KEYS_DUCK)


def _keys(spark, sf):
    return written(DD.key_table(DD.story_keys(items(spark, sf))))


@register("j01_same_story_pairs", CTE + "SELECT a, b, round(jaccard, 6) AS jaccard FROM jac")
def j01_same_story_pairs(spark, sf):
    return DD.jaccard_pairs(_keys(spark, sf)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@register("j02_contained_pairs", CTE + "SELECT a, b FROM cont")
def j02_contained_pairs(spark, sf):
    return DD.containment_pairs(_keys(spark, sf))


@register("c01_dedup_stories", with_ctes(ITEMS_DUCK, KEYS_DUCK + ",\n" + MIS_DUCK).replace("WITH ", "WITH RECURSIVE ", 1) +
          "SELECT leader_ord, item_id FROM best WHERE r = 1")
def c01_dedup_stories(spark, sf):
    return DD.dedup_stories(items(spark, sf)).select("leader_ord", "item_id")


@register("w01_best_of_group", with_ctes(ITEMS_DUCK, KEYS_DUCK + ",\n" + MIS_DUCK).replace("WITH ", "WITH RECURSIVE ", 1) +
          "SELECT leader_ord, item_id, group_rows FROM best WHERE r = 1")
def w01_best_of_group(spark, sf):
    it = items(spark, sf)
    keyed = DD.ranked_items(DD.story_keys(it))
    keys = written(DD.key_table(keyed))
    leaders = DD.elect_leaders(keys, DD.similar_edges(keys))
    # keys first, as in C01
    return DD.best_of_group(keyed.join(keys.select("story_key", "key_ord").join(leaders, "key_ord"), "story_key"))


@register("ub_word_sets", with_ctes(ITEMS_DUCK, f"""
ws AS (
  SELECT item_id,
    list_distinct(list_filter(str_split({D.normalise_headline('master_headline')}, ' '), lambda w: w <> '')) AS a,
    list_distinct(list_filter(str_split({D.normalise_headline('headline')}, ' '), lambda w: w <> '')) AS b
  FROM items
)""") + """
SELECT item_id, len(list_intersect(a, b)) AS n_intersection, len(list_distinct(list_concat(a, b))) AS n_union,
       len(list_filter(b, lambda w: NOT list_contains(a, w))) AS n_difference FROM ws""")
def ub_word_sets(spark, sf):
    from ..functions.text import normalise_headline
    it = items(spark, sf)
    a = token_set(normalise_headline("master_headline"))
    b = token_set(normalise_headline("headline"))
    return it.select("item_id", F.size(F.array_intersect(a, b)).cast("long").alias("n_intersection"),
                     F.size(F.array_union(a, b)).cast("long").alias("n_union"),
                     F.size(F.array_except(b, a)).cast("long").alias("n_difference"))
