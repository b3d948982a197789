"""Whole jobs and streams: approximate forms, item clustering, second pass, landing, paged text."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import cluster_jobs as CJ
from gleaner.operators import cluster_stats as CS
from gleaner.operators import clustering as CL
from gleaner.operators import text_ops as T
from gleaner.sources.fixtures import items
from gleaner.streaming import streams as SS
from tests.conftest import SF_SMALL


def _vectors(spark, X):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(X)], "id long, embedding array<double>")


def _clumps(n, k, spread, dims=8, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(k, dims)) * 4
    return centre[np.arange(n) % k] + r.normal(size=(n, dims)) * spread


def test_lsh_pairs_reach_the_recall_and_are_exact(spark):
    X = np.concatenate((_clumps(240, 30, .6), np.zeros((2, 8))))
    U = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-12)
    C = U @ U.T
    want = {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if C[i, j] >= 0.9}
    got = {(r.a, r.b): r.cosine for r in CJ.similar_pairs_lsh(_vectors(spark, X), 0.9).collect()}
    assert len(want) > 500 and set(got) <= want and len(got) >= 0.97 * len(want)
    assert all(abs(C[k] - c) < 1e-9 for k, c in got.items())
    near = CJ.nearest_neighbours(_vectors(spark, X[:60]), 4).collect()
    D = C[:60, :60] - 9 * np.eye(60)
    assert {(r.id, r.nbr) for r in near} == {(i, j) for i in range(60) for j in np.argsort(-D[i])[:4]}


def test_bisecting_is_marked_and_near_ward(spark):
    """On rows without far clumps; a wrong bisection of such is not undone (see README)."""
    df = _vectors(spark, np.random.default_rng(2).normal(size=(200, 8)))
    lab = CJ.bisecting_cluster(df, 5)
    assert lab.select("approximate").distinct().collect() == [(True,)]
    wcss = lambda x: x.select("id", "cluster_id").join(df, "id").transform(CS.inertia).agg(F.sum("inertia")).first()[0]
    assert wcss(lab) <= 1.3 * wcss(CL.hierarchical_cluster(df, n_clusters=5)[0])


@pytest.mark.parametrize("algorithm", ["density", "hierarchical", "bisecting"])
def test_cluster_items_returns_the_whole_job(spark, algorithm):
    it = items(spark, SF_SMALL).filter("item_id < 60")
    job = CJ.cluster_items(it, algorithm=algorithm, num_features=64)
    rows, run = job["items"].collect(), job["run"].first()
    assert len(rows) == it.count() and {"headline", "cluster_id", "is_noise", "cluster_probability", "outlier_score"} <= set(job["items"].columns)
    sizes = {r.cluster_id: r.size for r in job["summaries"].collect()}
    assert sum(sizes.values()) == sum(not r.is_noise for r in rows) and len(sizes) == run.total_clusters
    assert run.algorithm == algorithm and run.noise_items == sum(r.is_noise for r in rows) and run.total_items == len(rows)
    m = job["metrics"].first()
    assert m.n_items == len(rows) and run.is_valid == (not run.issues and run.quality_score >= 0.3)


def test_cluster_items_of_none(spark):
    job = CJ.cluster_items(items(spark, SF_SMALL).limit(0), algorithm="density")
    assert job["items"].count() == 0 and job["summaries"].count() == 0
    run = job["run"].first()
    assert not run.is_valid and run.total_items == 0
    with pytest.raises(ValueError):
        CJ.cluster_items(items(spark, SF_SMALL), algorithm="none")


def test_landing_keeps_null_keys_and_splits_large_ranges(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i) for i in range(200)], "id long, ord long").repartition(3)
    path, schema, width = SS.land_in_order(df, 4, "ord", file_rows=20)
    assert width == 3 and sorted(spark.read.parquet(path).collect(), key=str) == sorted(df.collect(), key=str)
    files = sorted((os.path.getmtime(f), f) for f in (os.path.join(path.replace("file:", ""), x) for x in os.listdir(path.replace("file:", ""))) if f.endswith(".parquet"))
    assert len(files) == 12
    ranges = [[r.ord for _, f in files[k:k + 3] for r in spark.read.parquet(f).collect()] for k in range(0, 12, 3)]
    assert ranges[0].count(None) == 29 and all(max(a) < min(b) for a, b in zip([[x or 0 for x in ranges[0]], *ranges[1:]], ranges[1:]))
    assert SS.land_in_order(df.limit(0), 4, "ord")[2] == 1


def test_second_pass_rewrites_only_the_batches_with_labels(spark):
    df = spark.createDataFrame([(i if i % 10 else None, f"h{i}", i) for i in range(40)], "item_id long, headline string, ord long")
    path, schema, width = SS.land_in_order(df, 4, "ord")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", width).parquet(path)
    out = SS.run_available_now(s, "t", foreach_batch=SS.append_batches)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(out.replace("file:", "")) for f in fs if f.endswith(".parquet")}
    before, mode = files(), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    labels = spark.createDataFrame([(3, 1), (5, 2), (999, 3)], "item_id long, cluster_id int")
    got = SS.fill_second_pass(spark, out, labels, "item_id").collect()
    after = files()
    assert len({os.path.dirname(f) for f in before - after}) == 1 and len(before & after) == len(before) - len(before - after) >= 3
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    assert len(got) == 40 and {r.headline: r.cluster_id for r in got if r.cluster_id} == {"h3": 1, "h5": 2}
    assert sum(r.item_id is None for r in got) == 4


def test_cluster_text_pages_join_to_the_whole_list(spark):
    r = np.random.default_rng(0)
    rows = [(int(r.choice([0, 0, 0, 1])), i, None if i % 9 == 0 else f"h{i}", "x" * int(r.integers(0, 60)) if i % 11 else None) for i in range(400)]
    rows.append((2, 500, "long", "y" * 5000))
    df = spark.createDataFrame(rows, "cluster_id int, ord long, headline string, short_description string").repartition(7)
    pages = T.cluster_text(df, page_chars=700).collect()
    for c in (0, 1, 2):
        want = "\n".join(f"- {h or ''}: {d or ''}" for k, _, h, d in rows if k == c)
        mine = sorted((p.page, p.cluster_text) for p in pages if p.cluster_id == c)
        assert "\n".join(t for _, t in mine) == want and all(len(t) <= 700 + 70 for _, t in mine if c < 2)
