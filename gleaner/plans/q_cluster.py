"""Queries for partition statistics over ``embeddings`` (labels as clusters)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster_stats as CS
from ..operators import vectors as VX
from ..operators.cluster_jobs import exemplars, nearest_neighbours, reassign_outliers, similar_pairs_lsh
from ..operators.series import dense_positions, prefix_agg
from ..sources.fixtures import ITEMS_DUCK, items, with_ctes
from ..sources.tables import table
from .registry import register


def _r6(c):
    return F.round(c, 6)


# ----------------------------------------------------------------------------
# views: clusters = embeddings with label as cluster id (−1 when vec_id % 13 = 0)
# ----------------------------------------------------------------------------
def clusters(spark, sf) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    it = items(spark, sf).select("item_id", "source", "headline", "technologies", "companies", "date", "ord")
    e = emb.select(F.col("vec_id").alias("id"), "embedding", "label",
                   F.when(F.col("vec_id") % 13 == 0, F.lit(-1)).otherwise(F.col("label")).alias("cluster_id"),
                   ((F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10).alias("label2"))
    return e.join(it, e.id == it.item_id, "left").drop("item_id").withColumn("ord", F.coalesce("ord", "id"))


CLUSTERS_DUCK = """
clusters AS (
  SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v, e.label,
         CASE WHEN e.vec_id % 13 = 0 THEN -1 ELSE e.label END AS cluster_id,
         (e.label + CASE WHEN e.vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS label2,
         i.source, i.headline, i.technologies, i.companies, i.date, coalesce(i.ord, e.vec_id) AS ord
  FROM embeddings e LEFT JOIN items i ON i.item_id = e.vec_id
),
cdim AS (
  SELECT cluster_id, i, avg(x) AS m, sum(x) AS s FROM (
    SELECT cluster_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM clusters WHERE cluster_id <> -1)
  GROUP BY 1, 2
),
cent AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM cdim GROUP BY 1),
csize AS (SELECT cluster_id, count(*) AS n FROM clusters WHERE cluster_id <> -1 GROUP BY 1)"""

CTE = with_ctes(ITEMS_DUCK, CLUSTERS_DUCK)


def _l2(a, b):
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda k: ({a}[k] - {b}[k]) * ({a}[k] - {b}[k]))))"


def _dot(a, b):
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda k: {a}[k] * {b}[k]))"


@register("a02_cluster_sizes", CTE + "SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1")
def a02_cluster_sizes(spark, sf):
    return CS.cluster_sizes(clusters(spark, sf))


@register("a31_run_shape", CTE + """
SELECT CAST(count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS BIGINT) AS n_clusters,
       CAST(count_if(cluster_id = -1) AS BIGINT) AS n_noise, count(*) AS n_items,
       (SELECT max(n) FROM csize) AS largest_cluster_size,
       round(count_if(cluster_id = -1) / count(*), 6) AS noise_ratio,
       round((SELECT max(n) FROM csize) / count(*), 6) AS largest_cluster_ratio
FROM clusters""")
def a31_run_shape(spark, sf):
    s = CS.run_shape(clusters(spark, sf))
    return s.select("n_clusters", "n_noise", "n_items", "largest_cluster_size",
                    _r6("noise_ratio").alias("noise_ratio"), _r6("largest_cluster_ratio").alias("largest_cluster_ratio"))


@register("a03_cluster_centroids", CTE + "SELECT cluster_id, CAST(i AS BIGINT) AS dim, round(m, 6) AS value FROM cdim")
def a03_cluster_centroids(spark, sf):
    c = CS.centroids(clusters(spark, sf))
    return c.select("cluster_id", F.posexplode("centroid").alias("dim", "value")).select(
        "cluster_id", (F.col("dim") + 1).cast("long").alias("dim"), _r6("value").alias("value"))


@register("a04_inertia", CTE + f"""
SELECT c.cluster_id, count(*) AS n, round(sum(pow({_l2('c.v', 't.c')}, 2)), 6) AS inertia
FROM clusters c JOIN cent t USING (cluster_id) GROUP BY 1""")
def a04_inertia(spark, sf):
    i = CS.inertia(clusters(spark, sf))
    return i.select("cluster_id", "n", _r6("inertia").alias("inertia"))


@register("a05_coherence", CTE + f"""
SELECT round(coalesce(avg(c), 0), 6) AS coherence FROM (
  SELECT a.cluster_id, avg({_dot('a.v', 'b.v')}) AS c FROM clusters a JOIN clusters b
  ON a.cluster_id = b.cluster_id AND a.id < b.id WHERE a.cluster_id <> -1 GROUP BY 1)""")
def a05_coherence(spark, sf):
    return CS.coherence(clusters(spark, sf)).select(_r6("coherence").alias("coherence"))


@register("a06_size_entropy", CTE + """
SELECT round(CASE WHEN count(*) <= 1 THEN 1.0 ELSE -sum(n / t * log2(n / t)) / log2(count(*)) END, 6) AS size_diversity
FROM csize, (SELECT sum(n) AS t FROM csize)""")
def a06_size_entropy(spark, sf):
    return CS.size_entropy(clusters(spark, sf)).select(_r6("size_diversity").alias("size_diversity"))


def _div_duck(label_sql: str, src: str, name: str) -> str:
    return f"""
SELECT round(coalesce(avg(d), 0), 6) AS {name} FROM (
  SELECT cluster_id, CASE WHEN count(*) > 1 THEN -sum(c / t * log2(c / t)) / log2(count(*)) ELSE 0 END AS d
  FROM (SELECT cluster_id, lbl, count(*) AS c, sum(count(*)) OVER (PARTITION BY cluster_id) AS t
        FROM (SELECT cluster_id, {label_sql} AS lbl FROM {src}) WHERE cluster_id <> -1 AND lbl IS NOT NULL GROUP BY 1, 2)
  WHERE cluster_id IN (SELECT cluster_id FROM csize WHERE n >= 2) GROUP BY 1)"""


@register("a07_source_diversity", CTE + _div_duck("coalesce(source, 'unknown')", "clusters", "source_diversity"))
def a07_source_diversity(spark, sf):
    return CS.source_diversity(clusters(spark, sf)).select(_r6("source_diversity").alias("source_diversity"))


@register("a08_topic_diversity", CTE + _div_duck(
    "t", "(SELECT cluster_id, unnest(list_concat(coalesce(technologies, []), coalesce(companies, []))) AS t FROM clusters)",
    "topic_diversity"))
def a08_topic_diversity(spark, sf):
    return CS.topic_diversity(clusters(spark, sf)).select(_r6("topic_diversity").alias("topic_diversity"))


@register("a09_temporal_diversity", CTE + "SELECT 0.5 AS temporal_diversity, (" +
          _div_duck("try_strptime(date, '%Y-%m-%d')", "clusters", "x").strip() + ") AS temporal_diversity_real")
def a09_temporal_diversity(spark, sf):
    c = clusters(spark, sf)
    return CS.temporal_diversity(c).crossJoin(
        CS.temporal_diversity(c, real=True).select(_r6("temporal_diversity").alias("temporal_diversity_real")))


@register("a10_calinski_harabasz", CTE + f"""
, mu AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (
    SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM clusters WHERE cluster_id <> -1) GROUP BY 1))
SELECT round(CASE WHEN k > 1 AND k < n THEN CASE WHEN w = 0 THEN 1.0 ELSE (b / (k - 1)) / (w / (n - k)) END END, 6) AS calinski_harabasz FROM
  (SELECT sum(s.n * pow({_l2('t.c', 'mu.c')}, 2)) AS b, count(*) AS k FROM cent t JOIN csize s USING (cluster_id), mu),
  (SELECT sum(pow({_l2('c.v', 't.c')}, 2)) AS w, count(*) AS n FROM clusters c JOIN cent t USING (cluster_id))""".replace(
    "\n, mu AS", ",\nmu AS", 1).replace("csize AS (SELECT cluster_id, count(*) AS n FROM clusters WHERE cluster_id <> -1 GROUP BY 1)\n,", "csize AS (SELECT cluster_id, count(*) AS n FROM clusters WHERE cluster_id <> -1 GROUP BY 1),"))
def a10_calinski_harabasz(spark, sf):
    return CS.calinski_harabasz(clusters(spark, sf)).select(_r6("calinski_harabasz").alias("calinski_harabasz"))


@register("a11_davies_bouldin", CTE + f"""
, sc AS (SELECT c.cluster_id, avg({_l2('c.v', 't.c')}) AS s FROM clusters c JOIN cent t USING (cluster_id) GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin FROM (
  SELECT a.cluster_id, max(CASE WHEN {_l2('a.c', 'b.c')} = 0 THEN 0 ELSE (sa.s + sb.s) / {_l2('a.c', 'b.c')} END) AS r
  FROM cent a JOIN cent b ON a.cluster_id <> b.cluster_id JOIN sc sa ON sa.cluster_id = a.cluster_id
  JOIN sc sb ON sb.cluster_id = b.cluster_id GROUP BY 1)""".replace("\n, sc AS", ",\nsc AS", 1))
def a11_davies_bouldin(spark, sf):
    return CS.davies_bouldin(clusters(spark, sf)).select(_r6("davies_bouldin").alias("davies_bouldin"))


_SIL_DUCK = f"""
, pd AS (
  SELECT a.id, a.cluster_id AS own, b.cluster_id AS other, avg({_l2('a.v', 'b.v')}) AS m, count(*) AS cnt
  FROM clusters a JOIN clusters b ON a.id <> b.id AND b.cluster_id <> -1 WHERE a.cluster_id <> -1 GROUP BY 1, 2, 3
), rs AS (
  SELECT id, max(CASE WHEN other = own THEN m END) AS a, min(CASE WHEN other <> own THEN m END) AS b,
         max(CASE WHEN other = own THEN cnt END) AS own_n FROM pd GROUP BY 1
)"""


@register("a12_silhouette", (CTE + _SIL_DUCK).replace("\n, pd AS", ",\npd AS", 1) + """
SELECT round(avg(CASE WHEN coalesce(own_n, 0) = 0 THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM rs""")
def a12_silhouette(spark, sf):
    return VX.silhouette(clusters(spark, sf)).select(_r6("silhouette").alias("silhouette"))


@register("a12_silhouette_fast", (CTE + _SIL_DUCK).replace("\n, pd AS", ",\npd AS", 1).replace(f"avg({_l2('a.v', 'b.v')})", f"avg(pow({_l2('a.v', 'b.v')}, 2))") + """
SELECT round(avg(CASE WHEN coalesce(own_n, 0) = 0 THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_fast FROM rs""")
def a12_silhouette_fast(spark, sf):
    """The linear form: squared distances, from per-cluster sums."""
    return VX.silhouette_fast(clusters(spark, sf)).select(_r6("silhouette_fast").alias("silhouette_fast"))


@register("j11_reference_label_pairs", CTE + "SELECT cluster_id AS la, label2 AS lb, count(*) AS n FROM clusters GROUP BY 1, 2")
def j11_reference_label_pairs(spark, sf):
    c = clusters(spark, sf)
    return CS.contingency(c, c, "id", "cluster_id", "label2").select(
        F.col("la").cast("int").alias("la"), F.col("lb").cast("int").alias("lb"), "n")


_CONT = """
, ct AS (SELECT cluster_id AS la, label2 AS lb, count(*) AS n FROM clusters GROUP BY 1, 2),
ra AS (SELECT la, sum(n) AS a FROM ct GROUP BY 1), rb AS (SELECT lb, sum(n) AS b FROM ct GROUP BY 1),
tot AS (SELECT sum(n) AS nn FROM ct)"""


@register("a13_adjusted_rand", (CTE + _CONT).replace("\n, ct AS", ",\nct AS", 1) + """
SELECT round(CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END, 6) AS adjusted_rand FROM (
  SELECT sij, sa * sb / (nn * (nn - 1) / 2.0) AS ex, (sa + sb) / 2.0 AS mx FROM
  (SELECT sum(n * (n - 1) / 2.0) AS sij FROM ct), (SELECT sum(a * (a - 1) / 2.0) AS sa FROM ra),
  (SELECT sum(b * (b - 1) / 2.0) AS sb FROM rb), tot)""")
def a13_adjusted_rand(spark, sf):
    c = clusters(spark, sf)
    return CS.adjusted_rand(CS.contingency(c, c, "id", "cluster_id", "label2")).select(_r6("adjusted_rand").alias("adjusted_rand"))


@register("a14_normalised_mutual_info", (CTE + _CONT).replace("\n, ct AS", ",\nct AS", 1) + """
SELECT round(CASE WHEN ha = 0 AND hb = 0 THEN 1.0 ELSE greatest(mi, 0) / ((ha + hb) / 2) END, 6) AS normalised_mutual_info FROM
  (SELECT sum(n / nn * ln(n * nn / (a * b))) AS mi FROM ct JOIN ra USING (la) JOIN rb USING (lb), tot),
  (SELECT sum(-(a / nn) * ln(a / nn)) AS ha FROM ra, tot), (SELECT sum(-(b / nn) * ln(b / nn)) AS hb FROM rb, tot)""")
def a14_normalised_mutual_info(spark, sf):
    c = clusters(spark, sf)
    return CS.normalised_mutual_info(CS.contingency(c, c, "id", "cluster_id", "label2")).select(
        _r6("normalised_mutual_info").alias("normalised_mutual_info"))


@register("a15_compare_runs", (CTE + _CONT).replace("\n, ct AS", ",\nct AS", 1) + """
SELECT (SELECT count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> -1) FROM clusters) AS clusters_1,
       (SELECT count(DISTINCT label2) FROM clusters) AS clusters_2,
       (SELECT CAST(count_if(cluster_id = -1) AS BIGINT) FROM clusters) AS noise_1, CAST(0 AS BIGINT) AS noise_2,
       (SELECT round(CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END, 6) FROM (
          SELECT sij, sa * sb / (nn * (nn - 1) / 2.0) AS ex, (sa + sb) / 2.0 AS mx FROM
          (SELECT sum(n * (n - 1) / 2.0) AS sij FROM ct), (SELECT sum(a * (a - 1) / 2.0) AS sa FROM ra),
          (SELECT sum(b * (b - 1) / 2.0) AS sb FROM rb), tot)) AS adjusted_rand""")
def a15_compare_runs(spark, sf):
    c = clusters(spark, sf)
    r1 = CS.run_shape(c, "cluster_id").select(F.col("n_clusters").alias("clusters_1"), F.col("n_noise").alias("noise_1"))
    r2 = CS.run_shape(c, "label2").select(F.col("n_clusters").alias("clusters_2"), F.col("n_noise").alias("noise_2"))
    ari = CS.adjusted_rand(CS.contingency(c, c, "id", "cluster_id", "label2")).select(_r6("adjusted_rand").alias("adjusted_rand"))
    return r1.crossJoin(r2).crossJoin(ari).select("clusters_1", "clusters_2", "noise_1",
                                                  F.col("noise_2").cast("long").alias("noise_2"), "adjusted_rand")


def _topk_duck(expr: str, k: int, name: str, src: str = "clusters", listed: bool = False) -> str:
    v = f"unnest({expr})" if listed else expr
    p = f"generate_subscripts({expr}, 1)" if listed else "0"
    return f"""
{name} AS (
  SELECT cluster_id, array_to_string(list(v || ':' || CAST(c AS VARCHAR) ORDER BY r), ',') AS top_{name}
  FROM (SELECT cluster_id, v, c, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, fo, fp) AS r
        FROM (SELECT cluster_id, v, count(*) AS c, arg_min(ord, (ord, pos)) AS fo, arg_min(pos, (ord, pos)) AS fp
              FROM (SELECT cluster_id, ord, {v} AS v, {p} AS pos FROM {src}) GROUP BY 1, 2))
  WHERE r <= {k} GROUP BY 1
)"""


@register("a16_value_counts_topk", with_ctes(ITEMS_DUCK, CLUSTERS_DUCK, _topk_duck("source", 3, "source"),
                                             _topk_duck("technologies", 5, "technologies", listed=True),
                                             _topk_duck("companies", 5, "companies", listed=True)) + """
SELECT s.cluster_id, top_source, top_technologies, top_companies FROM source s
LEFT JOIN technologies USING (cluster_id) LEFT JOIN companies USING (cluster_id)""")
def a16_value_counts_topk(spark, sf):
    c = clusters(spark, sf)
    s = CS.value_counts_topk(c, "source", 3)
    t = CS.value_counts_topk(c, "technologies", 5, explode=True)
    co = CS.value_counts_topk(c, "companies", 5, explode=True)
    return s.join(t, "cluster_id", "left").join(co, "cluster_id", "left")


@register("c03_normalize_vectors", CTE + """
SELECT id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 6) AS first FROM (
  SELECT id, CASE WHEN sqrt(list_sum(list_transform(v, lambda x: x * x))) > 0
             THEN list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) ELSE v END AS u
  FROM clusters)""")
def c03_normalize_vectors(spark, sf):
    c = clusters(spark, sf).select("id", CS.normalize("embedding").alias("u"))
    return c.select("id", _r6(F.sqrt(CS.sq_norm(F.col("u")))).alias("norm"), _r6(F.element_at("u", 1)).alias("first"))


@register("w02_exemplars", (CTE + f"""
, dist AS (SELECT c.id, c.cluster_id, {_l2('c.v', 't.c')} AS d, c.ord FROM clusters c JOIN cent t USING (cluster_id))""").replace(
    "\n, dist AS", ",\ndist AS", 1) + """
SELECT cluster_id, id, CAST(r AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d, ord) AS r FROM dist) WHERE r <= 3""")
def w02_exemplars(spark, sf):
    return exemplars(clusters(spark, sf), 3).select("cluster_id", "id", F.col("rank").cast("long").alias("rank"))


@register("k04_order_summaries", CTE + """
SELECT cluster_id, n AS size, row_number() OVER (ORDER BY n DESC, cluster_id) AS position FROM csize""")
def k04_order_summaries(spark, sf):
    s = CS.cluster_sizes(clusters(spark, sf).filter(F.col("cluster_id") != -1))
    p = dense_positions(s.select("cluster_id", "size"), F.col("size").desc(), F.col("cluster_id"))
    return p.select("cluster_id", "size", (F.col("pos") + 1).alias("position"))


@register("g11_demote_oversized", CTE + """
SELECT id, CASE WHEN cluster_id <> -1 AND (SELECT n FROM csize s WHERE s.cluster_id = c.cluster_id) > 45
                THEN -1 ELSE cluster_id END AS cluster_id FROM clusters c""")
def g11_demote_oversized(spark, sf):
    d = CS.demote_oversized(clusters(spark, sf), 45)
    return d.select("id", F.col("cluster_id").cast("int").alias("cluster_id"))


@register("g15_cluster_members", CTE + """
SELECT id, CASE WHEN cluster_id = -1 THEN 'noise' ELSE 'member' END AS kind FROM clusters WHERE cluster_id IN (3, -1)""")
def g15_cluster_members(spark, sf):
    c = clusters(spark, sf)
    m = c.filter(F.col("cluster_id") == 3).select("id", F.lit("member").alias("kind"))
    n = c.filter(F.col("cluster_id") == -1).select("id", F.lit("noise").alias("kind"))
    return m.unionByName(n)


@register("j06_attach_labels", CTE + """
SELECT i.item_id, i.headline, c.cluster_id, c.cluster_id = -1 AS is_noise FROM items i JOIN clusters c ON c.id = i.item_id""")
def j06_attach_labels(spark, sf):
    it = items(spark, sf).select("item_id", "headline")
    c = clusters(spark, sf).select(F.col("id").alias("item_id"), "cluster_id")
    return it.join(c, "item_id").withColumn("is_noise", F.col("cluster_id") == -1)


@register("c19_digest_target_k", "SELECT count(*) AS n, CAST(least(greatest(count(*) // 8, 3), 20) AS BIGINT) AS k FROM embeddings")
def c19_digest_target_k(spark, sf):
    e = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return e.select("n", CS.digest_target_k(F.col("n")).cast("long").alias("k"))


@register("g12_cluster_guard", "SELECT count(*) AS n, count(*) >= 3 AS run_clustering FROM embeddings")
def g12_cluster_guard(spark, sf):
    e = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return e.select("n", (F.col("n") >= 3).alias("run_clustering"))


@register("t32_batch_index", with_ctes(ITEMS_DUCK) +
          "SELECT item_id, CAST((row_number() OVER (ORDER BY ord) - 1) // 32 AS BIGINT) AS batch FROM items")
def t32_batch_index(spark, sf):
    return batch_index(items(spark, sf), 32).select("item_id", "batch")


def batch_index(df: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """Batch number by position, floor((position − 1) / size).

    Position is a running count; it runs per range of rows (two-level, like
    every running aggregate here), so no single task sees the whole table.
    """
    r = prefix_agg(df, [], [order], None, {"_pos": ("sum", F.lit(1))})
    return r.withColumn("batch", F.floor((F.col("_pos") - 1) / size).cast("long")).drop("_pos")


@register("s14_batch_files", CTE + """
, b AS (SELECT id, cluster_id, (row_number() OVER (ORDER BY id) - 1) // 200 AS batch FROM clusters),
per AS (SELECT batch, max(cluster_id) + 1 AS k FROM b GROUP BY 1),
off AS (SELECT batch, coalesce(sum(k) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM per)
SELECT id, CAST(batch AS BIGINT) AS batch,
       CAST(CASE WHEN cluster_id = -1 THEN -1 ELSE cluster_id + o END AS BIGINT) AS global_cluster_id
FROM b JOIN off USING (batch)""".replace("\n, b AS", ",\nb AS", 1))
def s14_batch_files(spark, sf):
    c = batch_index(clusters(spark, sf), 200, "id")
    return global_cluster_ids(c).select("id", "batch", "global_cluster_id")


def global_cluster_ids(df: DataFrame, batch: str = "batch", key: str = "cluster_id",
                       span: int = 10_000) -> DataFrame:
    """Per-batch cluster ids made globally unique: offset = clusters of earlier batches.

    The batch table grows with the data (one row per batch), so the running total
    of earlier batches is a two-level running sum, not one ordered window."""
    per = df.groupBy(batch).agg((F.max(key) + 1).alias("_k"))
    off = prefix_agg(per, [], [batch], F.floor(F.col(batch) / span), {"_upto": ("sum", "_k")}).select(
        batch, (F.col("_upto") - F.col("_k")).alias("_o"))
    j = df.join(off, batch)
    return j.withColumn("global_cluster_id", F.when(F.col(key) == -1, F.lit(-1))
                        .otherwise(F.col(key) + F.col("_o")).cast("long")).drop("_o")


@register("j09_nearest_cluster", (CTE + f"""
, dd AS (SELECT c.id, t.cluster_id AS cand, {_l2('c.v', 't.c')} AS d FROM clusters c JOIN cent t ON t.cluster_id <> c.cluster_id
         WHERE c.cluster_id <> -1)""").replace("\n, dd AS", ",\ndd AS", 1) + """
SELECT id, CAST(arg_min(cand, (d, cand)) AS BIGINT) AS best, round(min(d), 6) AS score FROM dd GROUP BY 1""")
def j09_nearest_cluster(spark, sf):
    c = clusters(spark, sf).filter(F.col("cluster_id") != -1)
    cent = CS.centroids(c)
    n = VX.nearest_centroid(c, cent, "id", "embedding", exclude_col="cluster_id")
    return n.select("id", F.col("best").cast("long").alias("best"), _r6("score").alias("score"))


@register("c14_reassign_outliers", (CTE + f"""
, cs AS (SELECT c.id, t.cluster_id AS cand,
         coalesce({_dot('c.v', 't.c')} / nullif(sqrt({_dot('c.v', 'c.v')}) * sqrt({_dot('t.c', 't.c')}), 0), 0) AS cosv
         FROM clusters c, cent t WHERE c.cluster_id = -1)""").replace("\n, cs AS", ",\ncs AS", 1) + """
SELECT c.id, CASE WHEN b.cosv > 0.15 THEN b.cand ELSE c.cluster_id END AS cluster_id FROM clusters c
LEFT JOIN (SELECT id, arg_max(cand, (cosv, -cand)) AS cand, max(cosv) AS cosv FROM cs GROUP BY 1) b USING (id)""")
def c14_reassign_outliers(spark, sf):
    c = clusters(spark, sf)
    return reassign_outliers(c, 0.15).select("id", F.col("cluster_id").cast("int").alias("cluster_id"))


@register("j07_similarity_pairs", CTE + f"""
SELECT a.id AS a, b.id AS b, round({_dot('a.v', 'b.v')} / (sqrt({_dot('a.v', 'a.v')}) * sqrt({_dot('b.v', 'b.v')})), 6) AS cosine
FROM clusters a JOIN clusters b ON a.id < b.id
WHERE {_dot('a.v', 'b.v')} / (sqrt({_dot('a.v', 'a.v')}) * sqrt({_dot('b.v', 'b.v')})) >= 0.3""")
def j07_similarity_pairs(spark, sf):
    c = clusters(spark, sf)
    return VX.similar_pairs(c, 0.3).select("a", "b", _r6("cosine").alias("cosine"))


_COS = f"{_dot('a.v', 'b.v')} / (sqrt({_dot('a.v', 'a.v')}) * sqrt({_dot('b.v', 'b.v')}))"


@register("j07_similarity_pairs_lsh", CTE + f"""
SELECT a.id AS a, b.id AS b, round({_COS}, 6) AS cosine FROM clusters a JOIN clusters b ON a.id < b.id WHERE {_COS} >= 0.45""")
def j07_similarity_pairs_lsh(spark, sf):
    """The form for large tables; exact but for pairs that no projection table brings together."""
    return similar_pairs_lsh(clusters(spark, sf), 0.45).select("a", "b", _r6("cosine").alias("cosine"))


@register("j07_nearest_neighbours", CTE + f"""
SELECT id, nbr, CAST(rank AS INTEGER) AS rank, round(cosine, 6) AS cosine FROM (
  SELECT a.id, b.id AS nbr, {_COS} AS cosine, row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS rank
  FROM clusters a JOIN clusters b ON a.id <> b.id) WHERE rank <= 3""")
def j07_nearest_neighbours(spark, sf):
    return nearest_neighbours(clusters(spark, sf), 3).select("id", "nbr", "rank", _r6("cosine").alias("cosine"))
