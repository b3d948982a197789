"""Statistics of a labelled partition of vectors.

Input: ``assignments(id, cluster_id, embedding ARRAY<FLOAT|DOUBLE>)`` with
``cluster_id = -1`` for noise.  Everything here is linear in the rows:
per-cluster vector sums come from MLlib's ``Summarizer`` (JVM-side, partial
aggregation before the shuffle), and the pairwise statistics (inertia,
coherence) use closed forms over those sums.  Only the exact silhouette needs
pair distances; it runs on the blocked pair kernel in ``vectors``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P


def as_double(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length arrays (sequential sum)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def normalize(c: str | Column) -> Column:
    """X / ‖x‖; a zero vector stays zero."""
    v = as_double(c)
    n = F.sqrt(sq_norm(v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cluster_sums(df: DataFrame, vec: str = "embedding", key: str = "cluster_id") -> DataFrame:
    """Per cluster: n, Σx (array), Σ‖x‖², via Summarizer (no explode)."""
    d = df.select(key, array_to_vector(as_double(vec)).alias("_v"), sq_norm(as_double(vec)).alias("_sq"))
    g = d.groupBy(key).agg(Summarizer.metrics("sum", "count").summary(F.col("_v")).alias("_s"),
                           F.sum("_sq").alias("sum_sq"))
    return g.select(key, F.col("_s.count").alias("n"), vector_to_array(F.col("_s.sum")).alias("sum_vec"), "sum_sq")


def centroids(df: DataFrame, vec: str = "embedding", key: str = "cluster_id", include_noise: bool = False) -> DataFrame:
    """Elementwise mean per cluster."""
    d = df if include_noise else df.filter(F.col(key) != -1)
    s = cluster_sums(d, vec, key)
    return s.select(key, "n", F.transform("sum_vec", lambda x: x / F.col("n")).alias("centroid"), "sum_vec", "sum_sq")


def cluster_sizes(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Rows per label, noise (−1) included."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def run_shape(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """A02 + A31: clusters, noise, noise ratio, largest cluster and its share."""
    s = cluster_sizes(df, key)
    return s.agg(
        F.count_if(F.col(key) != -1).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col(key) == -1, F.col("size"))), F.lit(0)).alias("n_noise"),
        F.sum("size").alias("n_items"),
        F.coalesce(F.max(F.when(F.col(key) != -1, F.col("size"))), F.lit(0)).alias("largest_cluster_size"),
    ).withColumn("noise_ratio", F.try_divide(F.col("n_noise"), F.col("n_items"))).withColumn(
        "largest_cluster_ratio", F.try_divide(F.col("largest_cluster_size"), F.col("n_items")))


def inertia(df: DataFrame, vec: str = "embedding", key: str = "cluster_id") -> DataFrame:
    """A04 per cluster: Σ‖x‖² − ‖Σx‖²/n (non-noise clusters)."""
    s = cluster_sums(df.filter(F.col(key) != -1), vec, key)
    return s.select(key, "n", (F.col("sum_sq") - sq_norm(F.col("sum_vec")) / F.col("n")).alias("inertia"))


def coherence(df: DataFrame, vec: str = "embedding", key: str = "cluster_id") -> DataFrame:
    """Mean over clusters with n ≥ 2 of the mean pairwise dot product,
    (‖Σx‖² − Σ‖x‖²) / (n(n−1)); 0 when there is none."""
    s = cluster_sums(df.filter(F.col(key) != -1), vec, key).filter(F.col("n") >= 2)
    per = s.select(((sq_norm(F.col("sum_vec")) - F.col("sum_sq")) / (F.col("n") * (F.col("n") - 1))).alias("c"))
    return per.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("coherence"))


def size_entropy(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Normalised entropy of cluster sizes (noise excluded); 1.0 with ≤ 1 cluster."""
    s = cluster_sizes(df.filter(F.col(key) != -1), key)
    tot = s.agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("k"))
    j = s.crossJoin(tot).select((F.col("size") / F.col("t")).alias("p"), "k")
    e = j.agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.max("k").alias("k"))
    return e.select(F.when(F.coalesce(F.col("k"), F.lit(0)) <= 1, F.lit(1.0))
                     .otherwise(F.col("h") / F.log2("k")).alias("size_diversity"))


def label_diversity(df: DataFrame, label: str, key: str = "cluster_id", min_rows: int = 2,
                    rows_per_cluster: DataFrame | None = None) -> DataFrame:
    """Mean over clusters (n ≥ min_rows) of the normalised entropy of ``label``.

    Two grouped aggregates: counts per (cluster, label), then entropy per cluster.
    """
    d = df.filter((F.col(key) != -1) & F.col(label).isNotNull())
    c = d.groupBy(key, label).agg(F.count(F.lit(1)).alias("c"))
    per = c.groupBy(key).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k"))
    sizes = (rows_per_cluster if rows_per_cluster is not None else
             df.filter(F.col(key) != -1).groupBy(key).agg(F.count(F.lit(1)).alias("rows")))
    per = per.join(sizes, key).filter(F.col("rows") >= min_rows)
    p = F.col("c") / F.col("t")
    h = c.join(per, key).groupBy(key, "k").agg(F.sum(-p * F.log2(p)).alias("h"))
    div = F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(F.lit(0.0))
    return h.select(key, div.alias("diversity"))


def source_diversity(df: DataFrame, key: str = "cluster_id", source: str = "source") -> DataFrame:
    """Mean per-cluster normalised source entropy over clusters with ≥ 2 rows."""
    d = df.withColumn(source, F.coalesce(F.col(source), F.lit("unknown")))
    return label_diversity(d, source, key).agg(F.coalesce(F.avg("diversity"), F.lit(0.0)).alias("source_diversity"))


def topic_diversity(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Same over exploded technologies + companies; clusters without topics skipped."""
    sizes = df.filter(F.col(key) != -1).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    ex = df.select(key, F.explode(F.concat(F.coalesce("technologies", F.array().cast("array<string>")),
                                           F.coalesce("companies", F.array().cast("array<string>")))).alias("topic"))
    return label_diversity(ex, "topic", key, rows_per_cluster=sizes).agg(
        F.coalesce(F.avg("diversity"), F.lit(0.0)).alias("topic_diversity"))


def temporal_diversity(df: DataFrame, key: str = "cluster_id", date_col: str = "date", real: bool = False) -> DataFrame:
    """The digest reports a constant 0.5; ``real=True`` gives the mean normalised
    entropy of day buckets per cluster instead."""
    if not real:
        return df.sparkSession.range(1).select(F.lit(0.5).alias("temporal_diversity"))
    d = df.withColumn("_day", F.try_to_date(F.col(date_col), "yyyy-MM-dd"))
    return label_diversity(d, "_day", key).agg(F.coalesce(F.avg("diversity"), F.lit(0.0)).alias("temporal_diversity"))


def calinski_harabasz(df: DataFrame, vec: str = "embedding", key: str = "cluster_id") -> DataFrame:
    """A10: (B/(k−1)) / (W/(n−k)) on non-noise rows; null unless 1 < k < n; 1 when W is 0."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    s = centroids(df, vec, key)
    mu = (df.filter(F.col(key) != -1).agg(Summarizer.mean(array_to_vector(as_double(vec))).alias("m"))
          .select(vector_to_array("m").alias("mu")))
    j = s.crossJoin(F.broadcast(mu))  # one row
    parts = j.agg(F.sum(F.col("n") * sq_norm(F.zip_with("centroid", "mu", lambda a, b: a - b))).alias("B"),
                  F.sum(F.col("sum_sq") - sq_norm("sum_vec") / F.col("n")).alias("W"),
                  F.sum("n").alias("_tot"), F.count(F.lit(1)).alias("_k"))
    ratio = F.try_divide(F.try_divide(F.col("B"), F.col("_k") - 1), F.try_divide(F.col("W"), F.col("_tot") - F.col("_k")))
    return parts.select(F.when((F.col("_k") > 1) & (F.col("_k") < F.col("_tot")),
                               F.when(F.col("W") == 0, F.lit(1.0)).otherwise(ratio)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vec: str = "embedding", key: str = "cluster_id") -> DataFrame:
    """Mean over clusters of max_j (S_i + S_j) / d(c_i, c_j), S = mean distance to centroid.

    A pair of equal centroids counts 0.  Rows meet their centroid in an ordinary
    join; clusters meet one another in blocks.
    """
    from .vectors import worst_ratio
    c = centroids(df, vec, key)
    rows = df.filter(F.col(key) != -1).join(c.select(key, "centroid"), key)
    S = rows.groupBy(key).agg(F.avg(l2_distance(as_double(vec), F.col("centroid"))).alias("S"))
    cs = c.join(S, key).select(key, "centroid", "S")
    return worst_ratio(cs, key, "centroid", "S").agg(F.avg("r").alias("davies_bouldin"))


def contingency(a: DataFrame, b: DataFrame, id_col: str, la: str, lb: str) -> DataFrame:
    """Counts of (label a, label b) over the rows both labelings share."""
    return a.select(id_col, F.col(la).alias("la")).join(b.select(id_col, F.col(lb).alias("lb")), id_col).groupBy(
        "la", "lb").agg(F.count(F.lit(1)).alias("n"))


def _comb2(c: Column) -> Column:
    return c * (c - 1) / 2.0


def adjusted_rand(cont: DataFrame) -> DataFrame:
    """ARI from the contingency table."""
    cells = cont.agg(F.sum(_comb2(F.col("n"))).alias("sij"), F.sum("n").alias("N"))
    ra = cont.groupBy("la").agg(F.sum("n").alias("a")).agg(F.sum(_comb2(F.col("a"))).alias("sa"))
    rb = cont.groupBy("lb").agg(F.sum("n").alias("b")).agg(F.sum(_comb2(F.col("b"))).alias("sb"))
    j = cells.crossJoin(ra).crossJoin(rb)
    exp = F.col("sa") * F.col("sb") / _comb2(F.col("N"))
    mx = (F.col("sa") + F.col("sb")) / 2.0
    return j.select(F.when(mx == exp, F.lit(1.0)).otherwise((F.col("sij") - exp) / (mx - exp)).alias("adjusted_rand"))


def normalised_mutual_info(cont: DataFrame) -> DataFrame:
    """MI / mean(H(a), H(b)) (arithmetic normaliser), natural logs."""
    N = cont.agg(F.sum("n").alias("_tot"))
    ra = cont.groupBy("la").agg(F.sum("n").alias("a"))
    rb = cont.groupBy("lb").agg(F.sum("n").alias("b"))
    j = cont.join(ra, "la").join(rb, "lb").crossJoin(N)
    mi = j.agg(F.sum(F.col("n") / F.col("_tot") * F.log(F.col("n") * F.col("_tot") / (F.col("a") * F.col("b")))).alias("mi"))
    ha = ra.crossJoin(N).agg(F.sum(-(F.col("a") / F.col("_tot")) * F.log(F.col("a") / F.col("_tot"))).alias("ha"))
    hb = rb.crossJoin(N).agg(F.sum(-(F.col("b") / F.col("_tot")) * F.log(F.col("b") / F.col("_tot"))).alias("hb"))
    r = mi.crossJoin(ha).crossJoin(hb)
    den = (F.col("ha") + F.col("hb")) / 2.0
    return r.select(F.when((F.col("ha") == 0) & (F.col("hb") == 0), F.lit(1.0))
                     .otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / den).alias("normalised_mutual_info"))


def value_counts_topk(df: DataFrame, value_col: str, k: int, key: str = "cluster_id", ord_col: str = "ord",
                      explode: bool = False) -> DataFrame:
    """Per cluster the top-k values by count; ties go to the value seen first
    (row order, then position inside the row's list), as a counter keeps them."""
    if explode:
        d = df.select(key, ord_col, F.posexplode(value_col).alias("_pos", "v"))
    else:
        d = df.select(key, ord_col, F.lit(0).alias("_pos"), F.col(value_col).alias("v"))
    c = d.groupBy(key, "v").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(ord_col, "_pos")).alias("first"))
    w = Window.partitionBy(key).orderBy(F.col("c").desc(), F.col("first").asc())
    top = c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return top.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("r", "v", "c"))), lambda s: F.concat(s["v"], F.lit(":"), s["c"].cast("string"))),
        ",").alias(f"top_{value_col}"))


def demote_oversized(df: DataFrame, cap: int = P.OVERSIZED_CLUSTER, key: str = "cluster_id") -> DataFrame:
    """Clusters larger than ``cap`` become noise with probability 0 (counts recomputed later)."""
    sizes = cluster_sizes(df.filter(F.col(key) != -1), key).withColumnRenamed("size", "_size")
    j = df.join(sizes, key, "left")
    big = F.coalesce(F.col("_size"), F.lit(0)) > cap
    out = j.withColumn(key, F.when(big, F.lit(-1)).otherwise(F.col(key)))
    if "cluster_probability" in df.columns:
        out = out.withColumn("cluster_probability", F.when(big, F.lit(0.0)).otherwise(F.col("cluster_probability")))
    return out.withColumn("is_noise", F.col(key) == -1).drop("_size")


def digest_target_k(n: Column) -> Column:
    """k = min(max(n div 8, 3), 20)."""
    return F.least(F.greatest(F.floor(n / 8), F.lit(3)), F.lit(20))


def partition_quality(shape: DataFrame, sil: DataFrame, sizes: DataFrame, key: str = "cluster_id") -> DataFrame:
    """0.4·(sil+1)/2 (if known) + 0.3·(1 − min(1, 2·noise)) + 0.2·count + 0.1·balance, clamped to [0, 1];
    0 with no cluster, 0.1 with one."""
    bal = sizes.filter(F.col(key) != -1).agg(F.stddev_pop("size").alias("sd"), F.avg("size").alias("mu"))
    j = shape.crossJoin(sil).crossJoin(bal)
    k, n = F.col("n_clusters"), F.col("n_items")
    lo, hi = F.greatest(F.lit(2.0), 0.02 * n), F.least(F.lit(50.0), 0.1 * n)
    count_score = (F.when((k < 2) | (k > 50), F.lit(0.0))
                    .when((k >= lo) & (k <= hi), F.lit(1.0))
                    .when(k < lo, k / lo).otherwise(hi / k))
    balance = F.greatest(F.lit(0.0), 1.0 - (F.col("sd") / F.col("mu")) / 2.0)
    sil_part = F.coalesce(0.4 * (F.col("silhouette") + 1.0) / 2.0, F.lit(0.0))
    raw = (sil_part + 0.3 * (1.0 - F.least(F.lit(1.0), 2.0 * F.col("noise_ratio"))) + 0.2 * count_score
           + 0.1 * F.coalesce(balance, F.lit(0.0)))
    return j.select(F.when(k == 0, F.lit(0.0)).when(k == 1, F.lit(0.1))
                     .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).alias("partition_quality"))
