"""Queries for the clustering jobs (iterative ones are rows-only and unit-tested against
brute-force twins) and for partition quality, validation and summaries (DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..operators import cluster_jobs as CJ
from ..operators import cluster_stats as CS
from ..operators import clustering as CL
from ..operators import vectors as VX
from ..operators.series import dense_positions
from ..sources.fixtures import ITEMS_DUCK, items, with_ctes
from ..sources.tables import table
from .q_cluster import CLUSTERS_DUCK, _SIL_DUCK, _div_duck, clusters
from .registry import register


def _r6(c):
    return F.round(c, 6)


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _ward(spark, sf):
    return CL.ward_dendrogram(_emb(spark, sf))


# ----------------------------------------------------------------------------
# hierarchical
# ----------------------------------------------------------------------------
@register("c06_hierarchical_cluster")
def c06_hierarchical_cluster(spark, sf):
    labels, _ = CL.hierarchical_cluster(_emb(spark, sf), n_clusters=10)
    return labels


@register("c06_bisecting_cluster")
def c06_bisecting_cluster(spark, sf):
    return CJ.bisecting_cluster(_emb(spark, sf), 10)


@register("c09_merge_table")
def c09_merge_table(spark, sf):
    """The full linkage table, and where each merge stands from the top: the last 30 are what a dendrogram shows."""
    m = dense_positions(_ward(spark, sf), F.col("height").desc(), F.col("a").desc())
    return m.select("a", "b", _r6("height").alias("height"), "size", (F.col("pos") + 1).alias("place"), (F.col("pos") < 30).alias("in_dendrogram"))


@register("c07_estimate_k")
def c07_estimate_k(spark, sf):
    e = _emb(spark, sf)
    return CL.estimate_k(e.count(), _ward(spark, sf))


@register("w10_second_difference")
def w10_second_difference(spark, sf):
    e = _emb(spark, sf)
    m = _ward(spark, sf)
    mk = min(10, e.count() // 2)
    return CL.elbow_table(m, e.count(), mk).select("k", _r6("wcss").alias("wcss")).crossJoin(
        CL.second_difference(CL.elbow_table(m, e.count(), mk), mk))


@register("k07_median_threshold")
def k07_median_threshold(spark, sf):
    return CL.median_threshold(_ward(spark, sf))


@register("c08_cut_at_threshold")
def c08_cut_at_threshold(spark, sf):
    e = _emb(spark, sf)
    m = _ward(spark, sf)
    t = float(CL.median_threshold(m).first()[0])
    return CL.cut_at_threshold(e, m, t)


# ----------------------------------------------------------------------------
# density
# ----------------------------------------------------------------------------
@register("c04_density_cluster")
def c04_density_cluster(spark, sf):
    labels, _ = CL.density_cluster(_emb(spark, sf), P.DENSITY["min_cluster_size"], P.DENSITY["min_samples"], tree=False)
    return labels.select("id", "cluster_id", _r6("cluster_probability").alias("cluster_probability"),
                         _r6("outlier_score").alias("outlier_score"))


@register("c10_cluster_hierarchy")
def c10_cluster_hierarchy(spark, sf):
    return CL.density_cluster(_emb(spark, sf), P.DENSITY["min_cluster_size"], P.DENSITY["min_samples"])[1]


@register("c05_assign_new")
def c05_assign_new(spark, sf):
    """Fit on rows with an even id, label the odd ones: nearest fitted row within its reach."""
    e = _emb(spark, sf)
    fit = e.filter(F.col("id") % 2 == 0)
    new = e.filter(F.col("id") % 2 == 1)
    labels, _ = CL.density_cluster(fit, tree=False)
    return CJ.assign_new(fit, labels, new)


# ----------------------------------------------------------------------------
# hybrid
# ----------------------------------------------------------------------------
@register("c11_hybrid_cluster")
def c11_hybrid_cluster(spark, sf):
    return CJ.hybrid_cluster(_emb(spark, sf))


@register("c13_merge_small")
def c13_merge_small(spark, sf):
    """Ward cut fine enough (k = n / 5) that some clusters are singletons, then merge them."""
    e = _emb(spark, sf)
    n = e.count()
    labels = CL.cut_k(e, _ward(spark, sf), max(2, n // 5))
    return CL.merge_small(labels.join(e, "id"), 2).select("id", "cluster_id")


# ----------------------------------------------------------------------------
# partition quality, validation, summaries (DuckDB oracles)
# ----------------------------------------------------------------------------
_PQ_DUCK = (with_ctes(ITEMS_DUCK, CLUSTERS_DUCK) + _SIL_DUCK).replace("\n, pd AS", ",\npd AS", 1) + """,
shape AS (SELECT count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> -1) AS k, count(*) AS n,
                 count_if(cluster_id = -1) / count(*) AS noise_ratio FROM clusters),
sil AS (SELECT avg(CASE WHEN coalesce(own_n, 0) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM rs),
bal AS (SELECT stddev_pop(n) AS sd, avg(n) AS mu FROM csize),
pq AS (
  SELECT CASE WHEN k = 0 THEN 0.0 WHEN k = 1 THEN 0.1 ELSE least(1.0, greatest(0.0,
    coalesce(0.4 * (s + 1.0) / 2.0, 0.0) + 0.3 * (1.0 - least(1.0, 2.0 * noise_ratio))
    + 0.2 * CASE WHEN k < 2 OR k > 50 THEN 0.0
                 WHEN k >= greatest(2.0, 0.02 * n) AND k <= least(50.0, 0.1 * n) THEN 1.0
                 WHEN k < greatest(2.0, 0.02 * n) THEN k / greatest(2.0, 0.02 * n)
                 ELSE least(50.0, 0.1 * n) / k END
    + 0.1 * coalesce(greatest(0.0, 1.0 - (sd / mu) / 2.0), 0.0))) END AS partition_quality
  FROM shape, sil, bal
)"""


def _pq(spark, sf):
    c = clusters(spark, sf)
    sil = VX.silhouette(c)
    return CS.partition_quality(CS.run_shape(c), sil, CS.cluster_sizes(c))


@register("c12_partition_quality", _PQ_DUCK + "\nSELECT round(partition_quality, 6) AS partition_quality FROM pq")
def c12_partition_quality(spark, sf):
    return _pq(spark, sf).select(_r6("partition_quality").alias("partition_quality"))


_VAL_DUCK = _PQ_DUCK + """,
coh AS (SELECT coalesce(avg(c), 0) AS coherence FROM (
  SELECT a.cluster_id, avg(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k]))) AS c
  FROM clusters a JOIN clusters b ON a.cluster_id = b.cluster_id AND a.id < b.id WHERE a.cluster_id <> -1 GROUP BY 1)),
src AS (""" + _div_duck("coalesce(source, 'unknown')", "clusters", "source_diversity").strip() + """),
val AS (
  SELECT list_filter([CASE WHEN n = 0 THEN 'Empty clustering result' END,
                      CASE WHEN k = 0 THEN 'No clusters found' WHEN k = n THEN 'Each item in its own cluster (over-clustering)' END,
                      CASE WHEN noise_ratio > 0.3 THEN 'Noise ratio exceeds maximum' END,
                      CASE WHEN s < 0.2 THEN 'Silhouette score below minimum' END,
                      CASE WHEN coherence < 0.4 THEN 'Cluster coherence below minimum' END,
                      CASE WHEN source_diversity < 0.2 THEN 'Source diversity below minimum' END], lambda x: x IS NOT NULL) AS issues,
         coalesce((s + 1.0) / 2.0 * 0.4, 0.0) + coherence * 0.3 + source_diversity * 0.2
           + greatest(0.0, 1.0 - noise_ratio * 2.0) * 0.1 AS quality_score
  FROM shape, sil, coh, src
)"""


@register("c15_validate_partition", _VAL_DUCK + """
SELECT array_to_string(issues, '; ') AS issues, coalesce(array_to_string(list_filter([
         CASE WHEN list_contains(issues, 'Silhouette score below minimum')
              THEN 'Consider adjusting clustering parameters or using different algorithm' END,
         CASE WHEN list_contains(issues, 'Cluster coherence below minimum')
              THEN 'Clusters may be too loose. Consider stricter parameters' END,
         CASE WHEN list_contains(issues, 'Source diversity below minimum')
              THEN 'Clusters may be biased toward specific sources' END], lambda x: x IS NOT NULL), '; '), '') AS recommendations,
       round(quality_score, 6) AS quality_score,
       len(issues) = 0 AND quality_score >= 0.3 AS is_valid FROM val""")
def c15_validate_partition(spark, sf):
    v = CJ.validate_partition(clusters(spark, sf))
    return v.select(F.array_join("issues", "; ").alias("issues"),
                    F.array_join("recommendations", "; ").alias("recommendations"), _r6("quality_score").alias("quality_score"), "is_valid")


def _top_duck(col: str) -> str:
    return f"""t_{col} AS (SELECT cluster_id, array_to_string(list(v || ':' || CAST(c AS VARCHAR) ORDER BY r), ',') AS top_{col}
         FROM (SELECT cluster_id, v, c, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, f, p) AS r
               FROM (SELECT cluster_id, v, count(*) AS c, min(ord) AS f, arg_min(p, (ord, p)) AS p
                     FROM (SELECT cluster_id, ord, unnest({col}) AS v, unnest(range(1, len({col}) + 1)) AS p FROM dist) GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1)"""


@register("c16_cluster_summaries", (with_ctes(ITEMS_DUCK, CLUSTERS_DUCK) + f"""
, dist AS (SELECT c.id, c.cluster_id, c.headline, c.source, c.technologies, c.companies, c.ord,
                  sqrt(list_sum(list_transform(range(1, len(c.v) + 1), lambda k: (c.v[k] - t.c[k]) * (c.v[k] - t.c[k])))) AS d
           FROM clusters c JOIN cent t USING (cluster_id)),
reps AS (SELECT cluster_id, coalesce(array_to_string(list_filter(list(headline ORDER BY d, ord), lambda x: x IS NOT NULL), ' | '), '') AS representatives FROM (
           SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d, ord) AS r FROM dist) WHERE r <= 3 GROUP BY 1),
srcs AS (SELECT cluster_id, array_to_string(list(v || ':' || CAST(c AS VARCHAR) ORDER BY r), ',') AS top_sources
         FROM (SELECT cluster_id, v, c, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, f) AS r
               FROM (SELECT cluster_id, source AS v, count(*) AS c, min(ord) AS f FROM dist GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1),
{_top_duck("technologies")},
{_top_duck("companies")},
md AS (SELECT cluster_id, count(*) AS size, avg(d) AS mean_distance FROM dist GROUP BY 1)""").replace("\n, dist AS", ",\ndist AS", 1) + """
SELECT cluster_id, size, representatives, top_sources, top_technologies, top_companies, round(mean_distance, 6) AS mean_distance
FROM md JOIN reps USING (cluster_id) JOIN srcs USING (cluster_id) LEFT JOIN t_technologies USING (cluster_id) LEFT JOIN t_companies USING (cluster_id)""")
def c16_cluster_summaries(spark, sf):
    return CJ.cluster_summaries(clusters(spark, sf)).select(
        "cluster_id", "size", "representatives", "top_sources", "top_technologies", "top_companies", _r6("mean_distance").alias("mean_distance"))


@register("c17_cluster_items")
def c17_cluster_items(spark, sf):
    """C17, the whole job: each item with its cluster, the cluster's summary, and the run's score, issues and metrics."""
    job = CJ.cluster_items(items(spark, sf), algorithm="density")
    run = job["run"].select("algorithm", "total_clusters", "noise_items", "is_valid", _r6("quality_score").alias("quality_score"),
                            F.array_join("issues", "; ").alias("issues"), F.array_join("recommendations", "; ").alias("recommendations"))
    metrics = job["metrics"].select("largest_cluster_size", _r6("silhouette").alias("silhouette"), _r6("coherence").alias("coherence"))
    it = job["items"].select("item_id", "headline", "cluster_id", "is_noise", _r6("cluster_probability").alias("cluster_probability"), _r6("outlier_score").alias("outlier_score"))
    about = job["summaries"].select("cluster_id", F.col("size").alias("cluster_size"), "representatives", "top_sources")
    return it.join(about, "cluster_id", "left").crossJoin(F.broadcast(run)).crossJoin(F.broadcast(metrics))  # one row each


def _murmur_duck(word: str, seed: int = 42) -> str:
    """32-bit MurmurHash3 of a word's UTF-8 bytes, unsigned, written out for DuckDB."""
    m, c1, c2 = 1 << 32, 0xCC9E2D51, 0x1B873593
    byte = lambda h, i: f"('0x' || substr({h}, 2 * ({i}) + 1, 2))::HUGEINT"
    rotl = lambda x, r: f"((({x}) * {1 << r}) % {m} + ({x}) // {1 << 32 - r})"
    scramble = lambda k: f"({rotl(f'(({k}) * {c1}::HUGEINT % {m})', 15)} * {c2}::HUGEINT % {m})"
    h, n = f"hex(encode({word}))", f"strlen({word})"
    block = " + ".join(f"{byte(h, f'4 * i + {j}')} * {1 << 8 * j}" for j in range(4))
    blocks = f"list_transform(range({n} // 4), lambda i: {scramble(block)})"
    body = f"list_reduce(list_prepend({seed}::HUGEINT, {blocks}), lambda a, k: ({rotl('xor(a::UBIGINT, k::UBIGINT)::HUGEINT', 13)} * 5 + {0xE6546B64}::HUGEINT) % {m})"
    rest = f"list_sum(list_transform(range({n} // 4 * 4, {n}), lambda i: {byte(h, 'i')} * pow(256, i % 4)::HUGEINT))"
    tail = f"CASE WHEN {n} % 4 = 0 THEN 0::HUGEINT ELSE {scramble(f'({rest})::HUGEINT')} END"
    mixed = f"xor(xor(({body})::UBIGINT, ({tail})::UBIGINT), {n}::UBIGINT)"
    step = "list_reduce([{x}, 16, 2246822507, 13, 3266489909, 16]::UBIGINT[], lambda a, b, i: CASE WHEN b < 100 THEN xor(a, a >> b::INT) ELSE ((a::HUGEINT * b::HUGEINT) % 4294967296)::UBIGINT END)"
    return step.replace("{x}", mixed).replace("lambda a, b, i:", "lambda a, b:")


@register("c02_featurize_text", f"""
WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]{{2,}}')) AS word FROM documents),
h AS (SELECT word, CAST({_murmur_duck("word")} % 1024 AS INTEGER) AS dim FROM (SELECT DISTINCT word FROM w)),
tf AS (SELECT id, dim, count(*) AS n FROM w JOIN h USING (word) GROUP BY 1, 2),
idf AS (SELECT dim, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY 1),
x AS (SELECT id, dim, n * idf AS x FROM tf JOIN idf USING (dim))
SELECT id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS value FROM x WHERE x <> 0""")
def c02_featurize_text(spark, sf):
    """Each text's values that are not zero."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    v = CJ.featurize_text(d, 1024)
    return v.select("id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0").select("id", "dim", _r6("value").alias("value"))
