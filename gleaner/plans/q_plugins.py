"""Queries for the plug points: embedder, splitter UDTF, health checks, vector mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plugins as PL
from ..operators import cluster_stats as CS
from ..sources.tables import table
from .registry import register


@register("f03_embedder", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents),
c AS (SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 8))::BIGINT % 384 AS INTEGER) AS dim, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, dim, CAST(CAST(n AS FLOAT) / CAST(sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS value FROM c""")
def f03_embedder(spark, sf):
    """Each document's values that are not zero."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = PL.embed_batches(d, "text", dim=384, batch_size=32)
    return e.select("doc_id", F.posexplode("embedding").alias("dim", "value")).filter("value > 0").select("doc_id", "dim", F.col("value").cast("double").alias("value"))


@register("f04_split_text")
def f04_split_text(spark, sf):
    chunks = PL.split_texts(table(spark, sf, "documents"), "doc_id", "text", 2000, 200)
    return chunks.select("doc_id", "pos", F.length("chunk").alias("chunk_len"), F.md5("chunk").alias("chunk_md5"))


@register("f05_vector_mean", """
SELECT label AS cluster_id, CAST(i AS BIGINT) AS dim, round(avg(x), 6) AS value FROM (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
GROUP BY 1, 2""")
def f05_vector_mean(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"), "embedding")
    c = CS.centroids(e, include_noise=True)
    return c.select("cluster_id", F.posexplode("centroid").alias("dim", "value")).select(
        "cluster_id", (F.col("dim") + 1).cast("long").alias("dim"), F.round("value", 6).alias("value"))


@register("f06_health_checks", """
SELECT * FROM (VALUES
  ('documents_present', CASE WHEN (SELECT count(*) FROM documents) > 0 THEN 'healthy' ELSE 'unhealthy' END),
  ('events_error_share', CASE WHEN (SELECT count_if(event_type = 'error') / count(*) FROM events) > 0.3 THEN 'degraded'
                              ELSE 'healthy' END),
  ('broken_check', 'error')) t(name, status)""")
def f06_health_checks(spark, sf):
    docs = table(spark, sf, "documents")
    ev = table(spark, sf, "events")

    def documents_present():
        n = docs.agg(F.count(F.lit(1))).first()[0]
        return ("healthy" if n > 0 else "unhealthy"), f"{n} documents"

    def events_error_share():
        share = ev.agg(F.avg((F.col("event_type") == "error").cast("double"))).first()[0]
        return ("degraded" if share > 0.3 else "healthy"), f"error share {share:.3f}"

    def broken_check():
        raise RuntimeError("dependency unreachable")

    r = PL.run_health_checks(spark, {"documents_present": documents_present,
                                     "events_error_share": events_error_share,
                                     "broken_check": broken_check})
    return r.select("name", "status")
