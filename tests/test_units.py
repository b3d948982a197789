"""Unit tests: brute-force twins for the iterative jobs and the hand-made edge rows."""

import json
import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.functions.html import html_text_exact, html_to_text
from gleaner.functions.jsonfix import sanitize_text
from gleaner.operators import alerts as AL
from gleaner.operators import cluster_jobs as CJ
from gleaner.operators import cluster_stats as CS
from gleaner.operators import clustering as CL
from gleaner.operators import dedup as DD
from gleaner.operators import gates
from gleaner.operators import metric_index as MI
from gleaner.operators import series as S
from gleaner.operators import sovereignty as SV
from gleaner.operators import vectors as VX
from gleaner.operators import verdicts as VD
from gleaner.sources import event_views as V
from gleaner.sources.fixtures import items
from tests import twins
from tests.conftest import SF_SMALL

rng = np.random.default_rng(7)


def _vec_df(spark, X):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(X)], "id long, embedding array<double>")


# ---------------------------------------------------------------------------
def _naive_ward_heights(X):
    clusters = {i: (1, X[i].copy()) for i in range(len(X))}
    hs = []
    while len(clusters) > 1:
        best = None
        ks = sorted(clusters)
        for ai, a in enumerate(ks):
            for b in ks[ai + 1:]:
                na, sa = clusters[a]
                nb, sb = clusters[b]
                d = math.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(sa / na - sb / nb)
                if best is None or d < best[0]:
                    best = (d, a, b)
        d, a, b = best
        na, sa = clusters.pop(a)
        nb, sb = clusters.pop(b)
        clusters[min(a, b)] = (na + nb, sa + sb)
        hs.append(d)
    return sorted(hs)


@pytest.mark.parametrize("top", [1, 12, CL.TOP])
def test_ward_matches_sequential(spark, top):
    """Rounds alone, rounds and the top in one task, the top alone."""
    X = np.random.default_rng(3).normal(size=(40, 5))
    m = CL.ward_dendrogram(_vec_df(spark, X), top=top).toPandas()
    assert m["size"].max() == 40
    assert len(m) == 39
    assert np.allclose(sorted(m["height"]), _naive_ward_heights(X))
    whole = CL.ward_dendrogram(_vec_df(spark, X), top=100).toPandas()
    key = lambda f: sorted(zip(f["a"], f["b"], f["size"]))
    assert key(m) == key(whole)


def test_elbow_wcss_equals_direct(spark):
    X = rng.normal(size=(30, 4))
    df = _vec_df(spark, X)
    m = CL.ward_dendrogram(df)
    wc = {r.k: r.wcss for r in CL.elbow_table(m, 30, 5).collect()}
    for k in (1, 3, 5):
        lab = CL.cut_k(df, m, k).toPandas().sort_values("id")["cluster_id"].to_numpy()
        direct = sum(((X[lab == c] - X[lab == c].mean(0)) ** 2).sum() for c in np.unique(lab))
        assert math.isclose(wc[k], direct, rel_tol=1e-9)


def _naive_mst_weight(X, core):
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    W = np.maximum(np.maximum(D, core[:, None]), core[None, :])
    in_t = [0]
    total = 0.0
    while len(in_t) < n:
        best = min((W[i, j], j) for i in in_t for j in range(n) if j not in in_t)
        total += best[0]
        in_t.append(best[1])
    return total


@pytest.mark.parametrize("n,clumps,min_samples,block_rows,keep", [(50, 1, 2, 1024, 16), (120, 4, 4, 16, 3), (90, 1, 3, 20, 2), (1, 1, 2, 4, 2)])
def test_mst_weight_matches_prim(spark, monkeypatch, n, clumps, min_samples, block_rows, keep):
    """Few kept neighbours and small blocks: the rest is searched over the index."""
    monkeypatch.setattr(CL, "KEEP", keep)
    r = np.random.default_rng(n)
    X = r.normal(size=(n, 3)) + 40 * r.integers(0, clumps, (n, 1))
    X[: n // 10] = X[0]  # copies
    df = _vec_df(spark, X)
    index = MI.build(df, block_rows=block_rows)
    core = CL.core_distances(df, min_samples)
    mst = CL.mutual_reachability_mst(df, core, index=index).toPandas()
    c = core.toPandas().sort_values("id")["core"].to_numpy()
    D = np.sort(np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)), axis=1)
    assert np.allclose(c, D[:, min_samples - 1] if n > 1 else 0)
    assert len(mst) == n - 1
    assert math.isclose(mst["w"].sum(), _naive_mst_weight(X, c), rel_tol=1e-9)


def test_few_wanted_rows_share_tasks(spark, monkeypatch):
    """A right row is sent once to all blocks of a share, and the least edges out are exact."""
    X = np.random.default_rng(5).normal(size=(200, 3))
    index = MI.build(_vec_df(spark, X), block_rows=20)
    state = spark.createDataFrame([(i, i % 4, 0.3 * (i % 3)) for i in range(200)], "id long, comp long, core double")
    wanted = state.filter("id % 20 = 0").withColumn("reach", F.lit(50.0))
    sent, deal = [], MI.deal
    monkeypatch.setattr(MI, "deal", lambda *a: sent.append(deal(*a)) or sent[-1])
    got = {r.id: (r.to, r.w) for r in CL._outside(wanted, index, state).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    for i in range(0, 200, 20):
        w, j = min((max(D[i, j], 0.3 * (i % 3), 0.3 * (j % 3)), j) for j in range(200) if j % 4 != i % 4)
        assert got[i][0] == j and math.isclose(got[i][1], w)
    assert index.n_blocks >= 10 and len(got) == 10
    assert sent[0].filter("side = 1").count() == 200


@pytest.mark.parametrize("clumps", [1, 6])
def test_nearest_over_the_index_is_exact_and_skips_far_blocks(spark, clumps):
    r = np.random.default_rng(clumps)
    X = r.normal(size=(400, 4)) + 60 * np.arange(400)[:, None] % (60 * clumps)
    Y = np.concatenate((X[:30], r.normal(size=(40, 4)) + 500))
    df = _vec_df(spark, X)
    index = MI.build(df, block_rows=32)
    near, seen = MI.nearest(index, index, 5)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    got = near.toPandas().sort_values(["id", "rank"])
    assert got["nbr"].tolist() == [j for i in range(400) for j in sorted(range(400), key=lambda j: (D[i, j], j))[:5]]
    assert seen["pairs"] == index.n_blocks ** 2 and (seen["compared"] < seen["pairs"] / 3 if clumps > 1 else seen["compared"] <= seen["pairs"])
    other = MI.build(_vec_df(spark, Y), block_rows=16, pivots=index.pivots)
    got = MI.nearest(other, index, 1, exclude_self=False)[0].toPandas().sort_values("id")
    assert got["nbr"].tolist() == np.sqrt(((Y[:, None] - X[None]) ** 2).sum(-1)).argmin(1).tolist()


def _leaves(spark, n, edges, m):
    ids = spark.createDataFrame([(i,) for i in range(n)], "id long")
    lab, tree = CL.leaf_clusters(ids, spark.createDataFrame(edges, "u long, v long, w double"), m)
    return lab.toPandas().sort_values("id"), tree.toPandas().sort_values("child")


def test_leaf_clusters_two_groups_and_noise(spark):
    lab, tree = _leaves(spark, 7, [(0, 1, .1), (1, 2, .1), (3, 4, .1), (4, 5, .1), (2, 3, 5.0), (5, 6, 9.0)], 3)
    assert lab["cluster_id"].tolist() == [0, 0, 0, 1, 1, 1, -1]
    assert tree["lambda_val"].tolist() == [0.2, 0.2, 0.0] and tree["child_size"].tolist() == [3, 3, 7]
    assert tree["parent"].tolist() == [2, 2, -1] and tree["is_leaf"].tolist() == [True, True, False]
    # three rows leave each leaf at 1 / .1, the root's six at 1 / 5 and its last one at 1 / 9
    assert np.allclose(tree["stability"], [3 * (10 - .2), 3 * (10 - .2), 6 / 5 + 1 / 9]) and np.allclose(tree["persistence"][:2], 9.8 / 10)


def test_single_pure_root_is_noise(spark):
    lab, tree = _leaves(spark, 4, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], 2)
    assert set(lab["cluster_id"]) == {-1} and len(tree) == 0


def test_leaf_clusters_of_one_row_and_of_none(spark):
    assert _leaves(spark, 1, [], 2)[0]["cluster_id"].tolist() == [-1]
    assert len(_leaves(spark, 0, [], 2)[0]) == 0


def test_merge_small_two_undersized_choose_each_other(spark):
    rows = [(0, 0, [0.0, 0.0]), (1, 1, [0.1, 0.0]), (2, 2, [10.0, 0.0]), (3, 2, [10.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, cluster_id int, embedding array<double>")
    out = {r.id: r.cluster_id for r in CL.merge_small(df, 2).collect()}
    # cluster 0 (singleton) joins 1; then 1 has two rows and stays
    assert out[0] == out[1] == 1 and out[2] == out[3] == 2


@pytest.mark.parametrize("k,dims,min_size,pieces", [(36, 2, 2, 8), (60, 2, 5, 8), (36, 1, 3, 3)])
def test_merge_small_equals_the_sequential_walk(spark, k, dims, min_size, pieces):
    r = np.random.default_rng(k + min_size)
    sizes = r.choice([1, 1, 1, 2, 3, 7], k)
    rows, i = [], 0
    for c, size in enumerate(sizes):
        centre = r.normal(size=dims) * 3
        for _ in range(size):
            rows.append((i, c * 3, (centre + r.normal(size=dims) * .1).tolist()))
            i += 1
    rows += [(i + 1, -1, [0.0] * dims), (i + 2, -1, [1.0] * dims)]
    df = spark.createDataFrame(rows, "id long, cluster_id int, embedding array<double>").repartition(pieces)
    member = [(c, v) for _, c, v in rows if c >= 0]
    ids = sorted({c for c, _ in member})
    walk = twins.merge_small_walk(ids, [sum(c == x for c, _ in member) for x in ids], [np.sum([v for c, v in member if c == x], axis=0) for x in ids], min_size)
    got = {r.id: r.cluster_id for r in CL.merge_small(df, min_size).collect()}
    assert got == {i: walk.get(c, -1) for i, c, _ in rows}


def test_merge_small_of_two_thousand_clusters_with_a_hot_target(spark):
    """2,000 clusters, most of one row, a third of them nearest to one large cluster."""
    r = np.random.default_rng(8)
    n = np.where(np.arange(2000) % 3 == 0, 1, r.choice([1, 2, 3], 2000))
    n[1000] = 500
    centre = r.normal(size=(2000, 3)) * np.where(np.arange(2000) % 3 == 0, .3, 6)[:, None]
    centre[1000] = 0
    s = centre * n[:, None]
    sums = spark.createDataFrame([(int(i), int(a), v.tolist()) for i, (a, v) in enumerate(zip(n, s))], "cid long, n long, s array<double>")
    walk = twins.merge_small_walk(range(2000), n, s, 2)
    target = {r.cid: r.target for r in CL.small_moves(sums, 2).collect()}

    def final(x):
        while x in target and x != -1:
            x = target[x]
        return x
    assert {c: final(c) for c in range(2000)} == walk


def test_merge_small_without_another_cluster_is_noise(spark):
    df = spark.createDataFrame([(0, 4, [1.0])], "id long, cluster_id int, embedding array<double>")
    assert [r.cluster_id for r in CL.merge_small(df, 2).collect()] == [-1]
    assert CL.merge_small(df.limit(0), 2).collect() == []


# ---------------------------------------------------------------------------
def _seq_cooldown(pdf, minutes=15):
    sent = []
    for _, g in pdf.sort_values(["ts", "alert_id"]).groupby("alert_type"):
        last = None
        for aid, ts in zip(g["alert_id"], g["ts"]):
            if last is None or ts >= last + pd.Timedelta(minutes=minutes):
                sent.append(aid)
                last = ts
    return sorted(sent)


def test_cooldown_doubling_matches_sequential(spark):
    al = V.alerts(spark, SF_SMALL)
    got = sorted(r.alert_id for r in AL.alert_cooldown(al, 15).select("alert_id").collect())
    assert got == _seq_cooldown(al.toPandas())


def test_dedup_matches_sequential_scan(spark):
    it = items(spark, SF_SMALL)
    keyed = DD.story_keys(it).select("item_id", "ord", "story_key", "violation_count", "axiom_check").toPandas()
    keys = keyed.groupby("story_key")["ord"].min().sort_values()
    gen = set(DD.P.GENERIC_WORDS)

    def similar(a, b):
        if len(a) > 10 and len(b) > 10 and (a in b or b in a):
            return True
        wa, wb = set(a.split()), set(b.split())
        if not wa or not wb:
            return False
        inter = wa & wb
        return len(inter) / len(wa | wb) >= 0.4 and len(inter - gen) >= 1

    order = list(keys.index)
    merged, leader = set(), {}
    for i, k1 in enumerate(order):
        if k1 in merged:
            continue
        leader[k1] = k1
        for k2 in order[i + 1:]:
            if k2 not in merged and similar(k1, k2):
                merged.add(k2)
                leader[k2] = k1
    want = {keys[leader[k]] for k in order}
    got = {r.leader_ord for r in DD.dedup_stories(it).select("leader_ord").collect()}
    assert got == want


@pytest.mark.parametrize("bucket", ["b", None])
def test_prefix_agg_equals_window(spark, bucket):
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 200), "t": np.arange(200), "v": rng.integers(0, 9, 200)})
    df = spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("t") / 17))
    got = S.prefix_agg(df, ["k"], ["t"], bucket, {"run": ("sum", "v"), "mx": ("max", "v")}).toPandas()
    pdf = pdf.sort_values(["k", "t"])
    pdf["run"] = pdf.groupby("k")["v"].cumsum()
    pdf["mx"] = pdf.groupby("k")["v"].cummax()
    m = got.merge(pdf, on=["k", "t"])
    assert len(m) == len(pdf)
    assert (m["run_x"] == m["run_y"]).all() and (m["mx_x"] == m["mx_y"]).all()


def test_row_pieces_split_a_hot_key_and_follow_its_order(spark):
    # one key and one day: only a cut by rows can split it
    df = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    with_conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        p = S.row_pieces(df, ["k"], ["t"]).groupBy("_piece").agg(
            F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_piece").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_conf)
    assert len(p) > 1 and max(r.n for r in p) < 2000
    assert all(a.hi < b.lo for a, b in zip(p, p[1:]))


def test_prefix_agg_keeps_a_null_key(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "k string, t int, v int")
    for bucket in (F.col("t"), None):
        got = {(r.k, r.t): r.run for r in S.prefix_agg(df, ["k"], ["t"], bucket, {"run": ("sum", "v")}).collect()}
        assert got == {(None, 1): 5, (None, 2): 11, ("a", 1): 7}


# ---------------------------------------------------------------------------
def test_sanitize_only_inside_strings():
    assert sanitize_text('{"a":"x\ny"}\n') == '{"a":"x\\ny"}\n'
    assert sanitize_text('{"a":"q\\"\t"}') == '{"a":"q\\"\\t"}'
    assert sanitize_text('"abc\\') == '"abc\\'


def test_html_twin_matches_parser_on_pages(spark):
    from gleaner.sources.tables import table
    pg = table(spark, SF_SMALL, "pages").select("page_id", "html", html_to_text("html").alias("twin")).toPandas()
    for html, twin in zip(pg["html"], pg["twin"]):
        assert twin == html_text_exact(html)


def test_core_with_three_aligned_fails(spark):
    ax = [(a, "ALIGNED", "a long enough reason") for a in (1, 2, 3)]
    df = spark.createDataFrame(
        [(1, 1, "h tion on", "d", "CONFIRMED", 1, "x" * 150, ax, ["c"], ["t"])],
        "item_id long, ord long, headline string, short_description string, reality_status string, "
        "violation_count int, linkedin_angle string, axiom_check array<struct<axiom_id:int,judgment:string,reason:string>>, "
        "companies array<string>, technologies array<string>")
    g = gates.quality_gate(gates.classify_tier(df, ["tion on"])).first()
    assert g.relevance_tier == "CORE" and g.quality_gate == "FAIL"
    assert "CORE with zero violations AND zero tensions" in g.quality_gate_detail


def test_bid_hits_forbidden(spark):
    df = spark.createDataFrame([(1, "forbidden fruit", "", [])], "item_id long, headline string, short_description string, technologies array<string>")
    assert gates.keyword_any(df, ["bid"]).first().has_keyword


def test_empty_headline_takes_first_verdict(spark):
    it = spark.createDataFrame([(1, ""), (2, "alpha beta")], "item_id long, headline string")
    vd = spark.createDataFrame([(5, "zzz", "KILL", "r5"), (3, "gamma", "KEEP", "r3")],
                               "v_ord long, v_headline string, verdict string, reason string")
    got = {r.item_id: r.kill_gate for r in VD.match_verdicts(it, vd).collect()}
    assert got == {1: "KEEP", 2: "NEEDS_REVIEW"}


@pytest.mark.parametrize("n", [1, 2, 20])
def test_floor_index_percentile(spark, n):
    vals = list(range(n))
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    r = df.agg(F.array_sort(F.collect_list("v")).alias("s"), F.count(F.lit(1)).alias("n")).select(
        S.discrete_percentile(F.col("s"), F.col("n"), 0.95).alias("p")).first().p
    assert r == vals[min(int(0.95 * n), n - 1)]


def test_trend_first_half_zero_is_stable(spark):
    df = spark.createDataFrame([(0.0, 5.0, 4)], "a double, b double, n long")
    assert df.select(S.trend_label(F.col("a"), F.col("b"), F.col("n"))).first()[0] == "stable"


def test_load_rules_rejects_missing_field(spark):
    d = tempfile.mkdtemp(prefix="rules-", dir="/tmp")
    p = os.path.join(d, "rules.json")
    with open(p, "w") as f:
        json.dump({"axioms": [{"id": 1, "title": "t", "description": "d", "keywords": []},
                              {"id": 2, "title": "t2", "keywords": []}]}, f)
    with pytest.raises(Exception):
        SV.load_rules(spark, p).collect()
    with open(p, "w") as f:
        json.dump({"axioms": [{"id": 1, "title": "t", "description": "d", "keywords": ["k"]}]}, f)
    assert SV.load_rules(spark, p).count() == 1


def _naive_linkage_heights(X, method):
    clusters = {i: [i] for i in range(len(X))}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    hs = []
    while len(clusters) > 1:
        best = None
        ks = sorted(clusters)
        for ai, a in enumerate(ks):
            for b in ks[ai + 1:]:
                sub = D[np.ix_(clusters[a], clusters[b])]
                d = {"single": sub.min(), "complete": sub.max(), "average": sub.mean()}[method]
                if best is None or d < best[0]:
                    best = (d, a, b)
        d, a, b = best
        clusters[min(a, b)] = clusters.pop(a) + clusters.pop(b) if a != min(a, b) else clusters.pop(a) + clusters.pop(b)
        hs.append((d, len(clusters[min(a, b)])))
    return sorted(hs)


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_other_linkages_match_naive(spark, method):
    X = rng.normal(size=(25, 3))
    m = CL.linkage_dendrogram(_vec_df(spark, X), method).toPandas()
    assert np.allclose(sorted(zip(m["height"], m["size"])), _naive_linkage_heights(X, method))


def test_single_linkage_cut(spark):
    df = _vec_df(spark, rng.normal(size=(30, 3)))
    lab, _ = CL.hierarchical_cluster(df, n_clusters=3, linkage="single")
    assert lab.select("cluster_id").distinct().count() == 3


def test_statistics_of_singletons_copies_and_zero_vectors(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [0.0, 0.0]), (4, 3, [0.0, 2.0]), (5, 3, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, cluster_id int, embedding array<double>")
    sil = {r.id: r.silhouette for r in VX.silhouette_rows(df).collect()}
    assert sil[0] == 0 and sil[2] == 0 and sil[3] == 0  # a = b = 0, singleton, singleton
    assert CS.davies_bouldin(df).first()[0] >= 0 and CS.calinski_harabasz(df).first()[0] > 0
    same = df.withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0)))
    assert CS.calinski_harabasz(same).first()[0] == 1.0 and CS.davies_bouldin(same).first()[0] == 0.0
    alone = df.withColumn("cluster_id", F.col("id").cast("int"))
    assert CS.calinski_harabasz(alone).first()[0] is None and VX.silhouette(alone).first()[0] == 0
    best = {r.id: (r.best, r.score) for r in VX.nearest_centroid(df, CS.centroids(df), "id", "embedding", metric="cosine").collect()}
    assert best[3] == (0, 0.0) and best[4][0] == 3


def test_breach_span_starts_at_the_first_breaching_reading(spark):
    from datetime import datetime
    from gleaner.operators import health as HL
    t = lambda h, m=0: datetime(2024, 1, 1 + h // 24, h % 24, m)
    rows = [(1, "a", t(1), 1), (2, "a", t(3), 200), (3, "a", t(3, 40), 200), (4, "a", t(30), 200), (5, "a", t(31), 1), (6, "b", t(2), 200)]
    df = spark.createDataFrame(rows, "op_id long, op string, ts timestamp, duration int")
    got = {r.op_id: (r.breach_seconds, r.sustained) for r in HL.sustained_breach(
        df, ["op"], F.col("duration") > 100, 1800, order=("ts", "op_id")).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (2400, True), 4: (27 * 3600, True), 5: (0, False), 6: (0, False)}


def test_cluster_job_empty_and_unknown(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    out = CJ.cluster_job(empty, "density")
    r = out["run"].first()
    assert (r.total_items, r.total_clusters, r.noise_items, r.is_valid) == (0, 0, 0, False)
    assert out["assignments"].count() == 0
    with pytest.raises(ValueError):
        CJ.cluster_job(empty, "kmeans-ish")


def test_cluster_job_density_runs(spark):
    X = np.vstack([rng.normal(0, 0.05, size=(10, 2)), rng.normal(5, 0.05, size=(10, 2))])
    out = CJ.cluster_job(_vec_df(spark, X), "density")
    r = out["run"].first()
    assert r.total_items == 20 and r.total_clusters >= 2


# ---------------------------------------------------------------------------
# properties
# ---------------------------------------------------------------------------
from gleaner.plans.funnel import rule_funnel, stage_flags  # noqa: E402
from gleaner.sources.fixtures import FIXTURE_CORE_PATTERNS as CORE, FIXTURE_SHOPPING_WORDS as SHOP  # noqa: E402


def test_kept_plus_rejects_is_input_and_gates_shrink(spark):
    it = items(spark, SF_SMALL)
    f = stage_flags(it, CORE, SHOP)
    n = it.count()
    kept = f.filter("passed_pre_kill").count()
    rej_q = f.filter(F.col("quality_gate") == "FAIL").count()
    rej_k = f.filter(F.col("passed_quality") & (F.col("kill_gate") == "PRE_KILL")).count()
    assert kept + rej_q + rej_k == n
    q = f.filter("passed_quality").count()
    capped = rule_funnel(it, CORE, SHOP).count()
    assert capped <= kept <= q <= n


def test_dedup_is_idempotent(spark):
    it = items(spark, SF_SMALL)
    once = DD.dedup_stories(it).select(it.columns)
    twice = DD.dedup_stories(once)
    assert sorted(r.item_id for r in once.select("item_id").collect()) == \
        sorted(r.item_id for r in twice.select("item_id").collect())


def test_partitioning_changes_nothing(spark):
    it = items(spark, SF_SMALL)
    a = gates.quality_gate(gates.classify_tier(it.repartition(7), CORE)).select("item_id", "quality_gate_detail")
    b = gates.quality_gate(gates.classify_tier(it.repartition(2), CORE)).select("item_id", "quality_gate_detail")
    assert sorted(a.collect()) == sorted(b.collect())
    c1 = sorted(r.leader_ord for r in DD.dedup_stories(it.repartition(5)).collect())
    c2 = sorted(r.leader_ord for r in DD.dedup_stories(it.repartition(1)).collect())
    assert c1 == c2


@pytest.mark.parametrize("n,m,spread", [(10, 3, 0.3), (60, 2, 1.5), (60, 4, 0.8), (90, 5, 2.5)])
def test_leaf_clusters_match_the_sequential_pass(spark, n, m, spread):
    from tests.twins import leaf_clusters_local
    X = np.vstack([rng.normal(c, spread, size=(n // 3, 2)) for c in (0, 6, 13)])
    X[1] = X[0]  # copies: weight 0
    df = _vec_df(spark, X)
    mst = CL.mutual_reachability_mst(df, CL.core_distances(df, 2)).cache()
    lab, tree = CL.leaf_clusters(df.select("id"), mst, m)
    lab, tree = lab.toPandas().sort_values("id"), tree.toPandas().sort_values("child")
    want, want_tree = leaf_clusters_local(np.arange(len(X)), mst.toPandas(), m)

    def groups(t):
        return {frozenset(g["id"].tolist()) for c, g in t.groupby("cluster_id") if c >= 0}
    assert groups(lab) == groups(want)
    assert np.allclose(lab["cluster_probability"], want["cluster_probability"]) and np.allclose(lab["outlier_score"], want["outlier_score"])
    assert tree["is_leaf"].sum() == len(want_tree) and (tree["child"] == np.arange(len(tree))).all()
    leaves = tree[tree["is_leaf"]]
    assert np.allclose(leaves["lambda_val"], want_tree["lambda_val"]) and sorted(leaves["child_size"]) == sorted(want_tree["child_size"])
    same_hierarchy(tree, list(mst.toPandas()[["u", "v", "w"]].itertuples(index=False, name=None)), m)


def same_hierarchy(tree, edges, m):
    up = {r.child: (r.child_size, r.lambda_val) for r in tree.itertuples()} | {-1: (-1, -1.0)}
    got = sorted((r.child_size, r.lambda_val, r.stability, r.is_leaf, *up[r.parent]) for r in tree.itertuples())
    want = twins.condensed_tree_walk(edges, m)
    assert len(got) == len(want)
    assert np.allclose(np.array(got, float), np.array(want, float), equal_nan=True)


@pytest.mark.parametrize("shape", ["chain", "random", "caterpillar"])
def test_condensed_hierarchy_equals_the_walk_over_the_edges(spark, shape):
    """Many splits: pairs of rows joined in rising order along a chain, at random, and to one growing cluster."""
    r = np.random.default_rng(5)
    k = 70
    edges = [(3 * i + a, 3 * i + a + 1, .01 * (1 + i % 5) + a * .001) for i in range(k) for a in (0, 1)]
    for i in range(1, k):
        to = {"chain": i - 1, "random": int(r.integers(0, i)), "caterpillar": 0}[shape]
        edges.append((3 * to + int(r.integers(0, 3)), 3 * i, 1.0 + (r.random() if shape == "random" else i * .01)))
    edges += [(1, 1000, 5.0), (1000, 1001, 1.2), (4, 1002, .9)]  # rows that fall out
    ids = spark.createDataFrame([(x,) for x in sorted({y for u, v, _ in edges for y in (u, v)})], "id long")
    lab, tree = CL.leaf_clusters(ids, spark.createDataFrame(edges, "u long, v long, w double"), 3)
    tree = tree.toPandas()
    assert len(tree) == 2 * tree["is_leaf"].sum() - 1 > 60
    same_hierarchy(tree, edges, 3)


@pytest.mark.parametrize("hub", [1 << 14, 12])
def test_components_of_chains_and_stars(spark, monkeypatch, hub):
    """With hubs of over 12 links split off as well."""
    from gleaner.operators import graph
    from gleaner.operators.graph import components
    monkeypatch.setattr(graph, "HUB_LINKS", hub)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 4999), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert set(got.values()) == {0, 1000, 4999} and len(got) == 301 + 201 + 2


def test_leader_election_raises_without_progress(spark):
    keys = spark.createDataFrame([(1,), (2,)], "key_ord long")
    with pytest.raises(RuntimeError):
        DD.elect_leaders(keys, spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"))


def test_median_threshold_windows(spark):
    hs = [float(x) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    m = spark.createDataFrame([(i, i + 1, h) for i, h in enumerate(hs)], "a long, b long, height double")
    for lo, hi in ((2, 10), (3, 5), (1, 4), (20, 30)):
        pick = [hs[len(hs) - t + 1] for t in range(lo, hi + 1) if 0 <= len(hs) - t + 1 < len(hs)]
        assert CL.median_threshold(m, lo, hi).first()[0] == float(np.median(pick or hs))


def test_split_recursive_chunks_fit_and_cover_the_text():
    from gleaner.functions.plugins import split_recursive
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(40)) for i in range(30))
    chunks = split_recursive(text, 200, 20)
    assert chunks and all(len(c) <= 200 for c in chunks)
    words = set(text.split())
    assert words == set(" ".join(chunks).split())
    assert split_recursive("short", 200, 20) == ["short"]
    assert split_recursive("", 200, 20) == []


def test_cooldown_is_partitioning_invariant(spark):
    al = V.alerts(spark, SF_SMALL)
    a = sorted(r.alert_id for r in AL.alert_cooldown(al.repartition(1), 15).select("alert_id").collect())
    b = sorted(r.alert_id for r in AL.alert_cooldown(al.repartition(6), 15).select("alert_id").collect())
    assert a == b


def test_html_blocks_break_lines_and_numeric_entities_decode(spark):
    pages = ["a<!-- x -->b<script>s</script>c", "it&#8217;s &#xe9;t&#233; &#128512; &amp;#65; &#0;", "plain"]
    got = [r.t for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").select(
        "i", html_to_text("html").alias("t")).orderBy("i").collect()]
    assert got == ["a\nb\nc", "it\u2019s \u00e9t\u00e9 \U0001F600 &#65; \ufffd", "plain"]


def test_mail_body_that_is_not_utf8_is_rejected(spark):
    import base64
    from gleaner.operators import text_ops as TO
    enc = lambda b: base64.urlsafe_b64encode(b).decode()
    schema = ("id long, payload struct<mimeType:string,headers:array<struct<name:string,value:string>>,body:struct<data:string>,"
              "parts:array<struct<mimeType:string,body:struct<data:string>,parts:array<struct<mimeType:string,body:struct<data:string>>>>>>")
    rows = [(1, ("text/html", [], (enc("caf\u00e9".encode()),), None)), (2, ("text/html", [], (enc(b"\xff\xfe bad"),), None)),
            (3, ("text/plain", [], (enc(b"x"),), None))]
    df = spark.createDataFrame(rows, schema)
    assert [r.body_html for r in TO.mail_rows(df).collect()] == ["caf\u00e9"]
    assert [r.id for r in TO.mail_rejects(df).collect()] == [2]


def test_value_at_rank_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 50 + [(7.0,)], "value double")
    assert [r[0] for r in S.value_at_rank(df, "value", F.col("_n") - 1).collect()] == [7.0]
    assert [r[0] for r in S.value_at_rank(df, "value", F.col("_n") - 2).collect()] == [5.0]


def test_dedup_with_resolutions_matches_sequential_over_many_stretches(spark):
    al = V.alerts(spark, SF_SMALL).withColumn("message", F.concat(F.lit("m"), (F.col("alert_id") % 7).cast("string")))
    done = al.filter(F.col("alert_id") % 3 != 0).select(
        "alert_id", (F.col("ts") + F.expr("INTERVAL 40 MINUTES")).alias("action_ts"))
    ends = {r.alert_id: r.action_ts for r in done.collect()}
    for res, known in ((done, ends), (None, {})):
        want = []
        for _, g in al.toPandas().sort_values(["ts", "alert_id"]).groupby("alert_type"):
            last, open_ = None, {}
            for r in g.itertuples():
                free = r.message not in open_ or known.get(open_[r.message], pd.Timestamp.max) <= r.ts
                if free and (last is None or r.ts >= last + pd.Timedelta(minutes=15)):
                    want.append(r.alert_id)
                    last, open_[r.message] = r.ts, r.alert_id
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = [r.alert_id for r in AL.alert_dedup(al, 15, res).select("alert_id").collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(got) == sorted(want) and len(want) > 3


def test_dedup_of_no_alerts_is_empty(spark):
    assert AL.alert_dedup(V.alerts(spark, SF_SMALL).limit(0), 15).count() == 0


def test_unknown_rule_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 12), (2, 13), (3, None)], "item_id int, rule_id int")
    got = {r.item_id: r.rule_title for r in SV.rule_lookup(df, SV.rule_table(spark)).collect()}
    assert got[1] == "Most failures are structural, not ideological" and got[2] is None and got[3] is None


@pytest.mark.parametrize("token_rows", [5, 10 ** 6])
def test_same_story_pairs_of_a_hot_token_equal_all_pairs(spark, token_rows):
    """A word that a third of the keys share, in keys of frequent words, is split into blocks; equal to comparing all."""
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    keys = set()
    while len(keys) < 150:
        n = int(r.integers(1, 6))
        keys.add(" ".join((["hot"] if len(keys) % 3 == 0 else []) + sorted(r.choice(words, n, replace=False))))
    keys = sorted(keys)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "story_key string, key_ord long")
    df = df.select("story_key", "key_ord", F.split("story_key", " ").alias("tokens"), F.length("story_key").alias("key_len")).withColumn("n_tok", F.size("tokens"))
    got = {(x.a, x.b): x.jaccard for x in DD.jaccard_pairs(df, 0.4, ("w0",), token_rows=token_rows).collect()}
    sets = [set(k.split()) for k in keys]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    want = {k: v for k, v in want.items() if v >= 0.4 and (sets[k[0]] & sets[k[1]]) - {"w0"}}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want) and len(want) > 300


def test_split_texts_equals_the_row_function(spark):
    from gleaner.functions import plugins as PL
    r = np.random.default_rng(1)
    texts = [None, "", "short", "word " * 900, "x" * 5000, "Zeile\n" * 300 + "\n\n" + "é" * 700] + [" ".join("w" * int(k) for k in r.integers(1, 40, 200)) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = sorted((x.id, x.pos, x.chunk) for x in PL.split_texts(df, "id", "text", 400, 50).collect())
    assert got == [(i, p, c) for i, t in enumerate(texts) for p, c in enumerate(PL.split_recursive(t, 400, 50))]
    assert PL.split_texts(df.limit(0), "id", "text", 400, 50).collect() == []


def test_html_named_references_decode_as_the_parser_does(spark):
    from html import unescape
    cases = ["a &eacute;&Uuml; b", "&lambda;&notin;&zwnj;x", "&unknown; &amp;eacute; &amp;amp;", "&#233;&#x1F600;&hearts;", "&fjlig;&NotEqualTilde;"]
    df = spark.createDataFrame([(i, f"<p>{c}</p>") for i, c in enumerate(cases)], "id int, html string")
    got = {r.id: r.t for r in df.select("id", html_to_text("html").alias("t")).collect()}
    assert got == {i: unescape(c) for i, c in enumerate(cases)}


def test_contained_strings_meet_few_others(spark):
    """Prefixes of twelve characters and strings of other lengths, out of few letters and words: every 3-gram is frequent."""
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcd"), n)) for n in r.integers(2, 6, 40)]
    texts = sorted({" ".join(r.choice(words, 10)) for _ in range(300)})
    parts = sorted({t[:12] for t in texts[::2]} | {t[5:5 + n] for n, t in zip([1, 2, 3, 5, 6, 11, 13, 30], texts)})
    o = spark.createDataFrame(list(enumerate(texts)), "oid long, ot string")
    i = spark.createDataFrame(list(enumerate(parts)), "iid long, it string")
    want = {(a, b) for a, t in enumerate(texts) for b, p in enumerate(parts) if p in t}
    assert {tuple(x) for x in VD.contained_pairs(o, i, "oid", "ot", "iid", "it").collect()} == want
    long_ = i.filter(F.length("it") >= 12)
    n = VD.contained_candidates(o, long_).count()
    assert n <= 2 * sum(len(parts[b]) >= 12 for _, b in want) < VD.contained_candidates(o, long_, (3,)).count()


@pytest.mark.parametrize("t", [0.2, 0.4, 0.7])
def test_same_story_pairs_of_short_and_long_keys_equal_all_pairs(spark, t):
    r = np.random.default_rng(5)
    sets = [set(r.choice(12, r.integers(1, 9), replace=False)) for _ in range(150)]
    df = spark.createDataFrame([(i, [f"w{x}" for x in sorted(s)], len(s)) for i, s in enumerate(sets)], "key_ord long, tokens array<string>, n_tok int")
    got = {(x.a, x.b): x.jaccard for x in DD.jaccard_pairs(df, t, ("w0",), token_rows=20).collect()}
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets)
            if i < j and len(a & b) / len(a | b) >= t and (a & b) - {0}}
    assert got == pytest.approx(want)


def test_same_story_candidates_are_not_shuffled(spark):
    """Keys of six words, all with one of three frequent words and most with two: next to none is similar to another."""
    keys = [(i, ["the", "of", "in"][: 1 + i % 3] + [f"r{i}x{j}" for j in range(3)]) for i in range(600)]
    df = spark.createDataFrame([(i, w, len(w)) for i, w in keys], "key_ord long, tokens array<string>, n_tok int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = DD.jaccard_pairs(df, 0.4, ())
        assert out.count() == 0
        plan = out._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # no row passes the join of the signatures: candidates are checked in it
    assert "array_intersect(h" in plan.toString()


def test_python_workers_get_small_batches(spark):
    """A batch of texts and what is made of it is bounded by rows and bytes."""
    from gleaner.functions import plugins as PL
    from gleaner.plans import registry
    registry.tune(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    df = spark.createDataFrame([(i, "word " * 700) for i in range(600)], "id long, text string").coalesce(1)
    sizes = df.mapInPandas(lambda it: (f.assign(n=len(f)).head(1)[["n"]] for f in it), "n long").collect()
    assert max(r.n for r in sizes) * 3500 <= 5 * 2 ** 20 and sum(r.n for r in sizes) == 600
    got = PL.split_texts(df, "id", "text", 2000, 200).groupBy("id").count().collect()
    assert len(got) == 600 and len({r["count"] for r in got}) == 1


def test_rows_are_dealt_out_no_more_often_in_larger_tables(spark, monkeypatch):
    """All-pairs work sends each row to a number of block pairs that does not grow with the table."""
    monkeypatch.setattr(VX, "BLOCK_ROWS", 8)
    X = rng.normal(size=(800, 4))
    for n in (400, 800):
        df = _vec_df(spark, X[:n])
        dealt = VX._pairs_input(df, df, "id", "embedding", None, None)
        assert dealt.count() <= 2 * n * VX.BLOCKS
        assert MI.build(df).n_blocks <= 2 * VX.BLOCKS
    assert VX.block_size(10 ** 9, 64) * 64 * 8 <= VX.BLOCK_BYTES  # bounded in memory
    assert VX.chunk_rows(10 ** 5) * 10 ** 5 <= 1 << 21


def test_larger_blocks_give_the_same_neighbours_sums_and_merges(spark, monkeypatch):
    groups = 5
    X = rng.normal(size=(groups, 6))[rng.integers(0, groups, 300)] + 0.3 * rng.normal(size=(300, 6))
    X[40:60] = X[0]
    df = _vec_df(spark, X).withColumn("cluster_id", F.col("id") % 3)
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    D = d.copy()
    np.fill_diagonal(D, np.inf)
    want = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), D[i]))[:2]}
    heights = None
    for rows in (60, 1024):
        monkeypatch.setattr(VX, "BLOCK_ROWS", rows)
        index = MI.build(df)
        near = MI.nearest(index, index, 2)[0].collect()
        assert {(r.id, r.nbr) for r in near} == want
        sums = {(r.id, r.cluster): (r.sum_dist, r.cnt) for r in VX.cluster_distance_sums(df).collect()}
        for i in (0, 45, 299):
            for c in range(3):
                at = [j for j in range(300) if j % 3 == c and j != i]
                assert sums[i, c] == (pytest.approx(d[i, at].sum()), len(at))
        h = sorted(r.height for r in CL.ward_dendrogram(df, top=150).collect())
        heights = heights or h
        assert h == pytest.approx(heights)


def test_row_cut_bounds_the_kth_least():
    S = rng.normal(size=(7, 1003))
    for k in (1, 3, 16, 1000):
        cut, least = VX.row_cut(S, k)[:, 0], np.sort(S, axis=1)[:, k - 1]
        assert (cut >= least).all() and ((S <= cut[:, None]).sum(1) <= 2 * k + 8).all()


def test_pairs_of_several_projected_buckets_come_once(spark):
    """Pairs that share several buckets, and copies of a row, are returned once; a row without a partner not at all."""
    X = rng.normal(size=(200, 64))
    X[100:] = X[:100] + 0.2 * rng.normal(size=(100, 64))
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    got = [(r.a, r.b) for r in CJ.similar_pairs_lsh(_vec_df(spark, X), 0.9).collect()]
    assert sorted(got) == [(i, j) for i in range(200) for j in range(i + 1, 200) if U[i] @ U[j] >= 0.9]


def test_silhouette_of_many_clusters_keeps_a_bounded_number_of_sums(spark):
    """A row's sums are not kept for every cluster; repeated ids are taken together."""
    X, c = rng.normal(size=(400, 4)), rng.integers(0, 80, 400)
    c[:150] = 7  # a cluster of several blocks
    ids = np.arange(400)
    ids[300:310] = ids[310:320]
    df = spark.createDataFrame([(int(i), int(k), [float(x) for x in v]) for i, k, v in zip(ids, c, X)], "id long, cluster_id int, embedding array<double>")
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    for rows in (64, 1024):
        got = {r.id: (r.a, r.b) for r in VX.silhouette_rows(df, block_rows=rows).collect()}
        assert VX._cluster_means(df, "id", "embedding", "cluster_id", rows).count() <= 16 * 400  # not 80 clusters * 400
        for i in set(ids.tolist()):
            at = np.flatnonzero(ids == i)
            others = {k: np.flatnonzero((c == k) & (ids != i)) for k in set(c.tolist())}
            mean = {k: d[np.ix_(at, o)].mean() for k, o in others.items() if len(o)}
            own = set(c[at].tolist())
            b = min(m for k, m in mean.items() if k not in own or len(own) > 1)
            a = [mean[k] for k in own if k in mean]
            assert got[i][1] == pytest.approx(b) and (got[i][0] == pytest.approx(max(a)) if a else got[i][0] is None)


def test_one_task_finish_takes_ties_by_the_smaller_ids():
    X = rng.integers(0, 3, size=(60, 3)).astype(float)
    got = next(CL._merge_top(0)([pd.DataFrame({"cid": np.arange(60), "n": 1, "s": list(X)})]))
    n, s, want = np.ones(60), X.copy(), []
    left = list(range(60))
    while len(left) > 1:
        d = {(a, b): math.sqrt(2 * n[a] * n[b] / (n[a] + n[b])) * np.sqrt(((s[a] / n[a] - s[b] / n[b]) ** 2).sum()) for a in left for b in left if a < b}
        a, b = min(d, key=lambda p: (d[p], p))
        want.append((a, b))
        n[a], s[a] = n[a] + n[b], s[a] + s[b]
        left.remove(b)
    assert CL.TOP >= 4096 and sorted(got["height"]) == pytest.approx(_naive_ward_heights(X)) and list(zip(got["a"], got["b"])) == want


def test_report_rows_shuffle_only_items_that_have_a_vector(spark, tmp_path):
    """Of 40 items the 12 with a vector are reported; ids come first, so the texts of the others go nowhere."""
    from gleaner.plans import q_verdicts, registry
    docs = [(i, f"story number {i} of the day and so on it goes {i}", "s", "en", 40) for i in range(40)] + [(4, "story again 4", "s", "en", 13), (None, "no id", "s", "en", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, [float(i), 1.0], i % 3) for i in range(0, 36, 3)] + [(99, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    registry.tune(spark)
    out = q_verdicts.t23_report_row(spark, str(tmp_path))
    got = sorted((r.item_id, r.kill_gate, r.kill_gate_reason) for r in out.select("item_id", "kill_gate", "kill_gate_reason").collect())
    assert [g[0] for g in got] == list(range(0, 36, 3))
    assert got[0] == (0, "KEEP", "r0") and got[1] == (3, "KILL", "r3")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 1


def test_same_story_words_are_checked_where_keys_meet(spark):
    """No words come back to a pair, and keys that share an order number stay two keys."""
    keys = [(1, "a b c d e"), (1, "f g h i j k l m"), (2, "a b c d e x"), (None, "a b c d e y")]
    df = spark.createDataFrame(keys, "key_ord long, story_key string").select("key_ord", F.split("story_key", " ").alias("tokens"))
    out = DD.jaccard_pairs(df, 0.4, ())
    assert [(r.a, r.b, r.jaccard) for r in out.collect()] == [(1, 2, 5 / 6)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    meets = next(i for i, x in enumerate(plan) if "array_intersect" in x and "Join" in x)
    assert not any("Join" in x for x in plan[:meets])


def test_leaders_of_random_graphs(spark):
    """First come, first served; an absorbed key goes to its earliest leader, whichever round found it."""
    r = np.random.default_rng(8)
    links = {tuple(sorted(map(int, x))) for x in r.integers(0, 120, (260, 2)) if x[0] != x[1]} | {(200, 203), (201, 202), (201, 203), (202, 204)}
    lead = {}
    for k in sorted(range(205)):
        mine = [a for a, b in links if b == k and lead[a] == a]
        lead[k] = min(mine, default=k)
    keys = spark.range(205).withColumnRenamed("id", "key_ord")
    got = {x.key_ord: x.leader_ord for x in DD.elect_leaders(keys, spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert got == lead


def test_groups_are_ranked_by_counts_not_by_lists(spark):
    """The judgments are counted before the items are shuffled."""
    check = "array<struct<axiom_id:int,judgment:string,reason:string>>"
    rows = [(1, 1, "k", 2, None), (2, 2, "k", 2, [(1, "TENSION", "x"), (2, None, "y")]), (3, 3, "k", 1, [(1, "TENSION", "x")] * 3), (4, 4, "k", None, [])]
    it = DD.ranked_items(spark.createDataFrame(rows, f"item_id long, ord long, story_key string, violation_count int, axiom_check {check}"))
    assert "axiom_check" not in it.columns and sorted((x.item_id, x.tensions) for x in it.collect()) == [(1, 0), (2, 1), (3, 3), (4, 0)]
    best = DD.best_of_group(it.withColumn("leader_ord", F.lit(1)).withColumn("key_ord", F.lit(1))).first()
    assert best.item_id == 2 and best.group_rows == 4


def test_blocks_of_one_index_meet_once(spark, monkeypatch):
    """Two blocks that search each other share a group, and the neighbours stay exact."""
    X = np.random.default_rng(3).normal(size=(240, 8))
    X[100:110] = X[0]
    index = MI.build(_vec_df(spark, X), block_rows=20)
    sent, deal = [], MI.deal
    monkeypatch.setattr(MI, "deal", lambda *a, **k: sent.append(deal(*a, **k)) or sent[-1])
    near, seen = MI.nearest(index, index, 3)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    got = near.toPandas().sort_values(["id", "rank"])
    assert got["nbr"].tolist() == [int(j) for i in range(240) for j in np.lexsort((np.arange(240), D[i]))[:3]]
    assert sum(s.count() for s in sent) <= 240 * (index.n_blocks + 2) and seen["compared"] > seen["pairs"] / 2


@pytest.mark.parametrize("block_rows", [30, 1000])
def test_similar_pairs_meet_once(spark, block_rows):
    """A row is sent once to each block, not once for each side; ids that repeat or are null make no pair of their own."""
    X = np.random.default_rng(4).normal(size=(200, 3))
    X[5] = 0
    ids = [None if i == 7 else 20 if i == 21 else i for i in range(200)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, X)], "id long, embedding array<double>")
    got = sorted((r.a, r.b) for r in VX.similar_pairs(df, 0.9, block_rows=block_rows).collect())
    U = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)
    assert got == sorted((min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(200) for j in range(i + 1, 200)
                         if 7 not in (i, j) and ids[i] != ids[j] and U[i] @ U[j] >= 0.9)
    assert VX._own_pairs_input(df, "id", "embedding", block_rows).count() == 200 * math.ceil(200 / block_rows)


def test_nearest_ward_is_the_least_distance_then_id():
    """Sizes in long and short runs, ties, rows far from the middle, rows beyond single precision."""
    r = np.random.default_rng(7)
    far = 1e4 + r.normal(size=(500, 4)) * 1e-3
    for X in (r.normal(size=(900, 4)), r.integers(0, 3, size=(900, 3)).astype(float), np.r_[far, r.normal(size=(400, 4))], r.normal(size=(900, 4)) * 1e20):
        n = np.r_[np.ones(600), r.integers(1, 40, 300)]
        rid, own = r.permutation(900), np.r_[np.arange(700), np.full(200, -1)]
        nn, dist = VX.nearest_ward(X, n, X, n, rid, own)
        for i in range(900):
            d = np.sqrt(2.0 * n[i] * n / (n[i] + n)) * VX.exact_distance(np.broadcast_to(X[i], X.shape), X)
            if own[i] >= 0:
                d[i] = np.inf
            assert nn[i] == np.lexsort((rid, d))[0] and dist[i] == d[nn[i]]
    assert VX.nearest_ward(X[:1], n[:1], X[:1], n[:1], rid[:1], np.zeros(1, int))[0].tolist() == [-1]
    sizes = np.sort(np.r_[np.ones(9000, int), np.full(700, 2), np.arange(3, 300), np.full(5000, 400)])
    cuts = VX._tiles(sizes)
    assert [x for s, e in cuts for x in range(s, e)] == list(range(len(sizes))) and max(e - s for s, e in cuts) <= VX._RIGHT


def test_the_top_in_one_task_holds_no_table_of_distances(monkeypatch):
    """6,000 clusters in one task, in less than half of the memory of the table of their distances."""
    import tracemalloc
    X = np.random.default_rng(5).normal(size=(6000, 8))
    X[5000:5050] = X[4000]
    pdf = pd.DataFrame({"cid": np.arange(6000), "n": 1, "s": list(X)})
    monkeypatch.setattr(CL, "LAST", 50, raising=False)
    tracemalloc.start()
    got = next(CL._merge_top(0)([pdf]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6000 * 4 and len(got) == 5999 and got["size"].max() == 6000 and (got["height"] == 0).sum() == 50
    assert (got["height"] ** 2 / 2).sum() == pytest.approx(((X - X.mean(axis=0)) ** 2).sum())  # WCSS of one cluster


@pytest.mark.parametrize("last", [1, 12])
def test_rounds_in_one_task_match_the_sequential_merges(monkeypatch, last):
    X = np.random.default_rng(9).normal(size=(60, 4))
    X[40:45] = X[3]
    pdf = pd.DataFrame({"cid": np.arange(60), "n": 1, "s": list(X)})
    want = next(CL._merge_top(0)([pdf]))
    monkeypatch.setattr(CL, "LAST", last, raising=False)
    got = next(CL._merge_top(0)([pdf]))
    key = lambda f: sorted(zip(f["a"], f["b"], f["size"]))
    apart = lambda f: f[f["height"] > 1e-9]  # noqa: E731  copies join in any order
    assert key(apart(got)) == key(apart(want)) and sorted(got["height"]) == pytest.approx(_naive_ward_heights(X), abs=1e-9)


def test_copies_of_a_row_take_no_rounds(spark):
    """40 copies of one row, three of another: joined at once, not one pair of them a round."""
    X = np.random.default_rng(4).normal(size=(60, 3))
    X[10:49], X[50:52] = X[5], X[49]
    got = CL.ward_dendrogram(_vec_df(spark, X), top=1).toPandas()
    assert got["round"].max() < 25 and sorted(got["height"]) == pytest.approx(_naive_ward_heights(X), abs=1e-9)
    whole = CL.ward_dendrogram(_vec_df(spark, X), top=100).toPandas()
    got, whole = (f[f["height"] > 1e-9] for f in (got, whole))  # copies join in any order
    assert sorted(zip(got["a"], got["b"], got["size"])) == sorted(zip(whole["a"], whole["b"], whole["size"]))


def test_a_ward_search_is_dealt_to_few_pairs_of_blocks():
    """Pairs of blocks are enough for the tasks, blocks within their bytes, and rows dealt out a few times."""
    for wanted, active in ((1, 1), (0, 70_000), (600_000, 600_000), (150_000, 600_000), (90_000, 100_000_000)):
        bl, br = CL._ward_blocks(wanted, active, 64)
        assert math.ceil(wanted / bl) * 512 <= CL.SEARCH_BYTES and math.ceil(active / br) * 512 <= CL.SEARCH_BYTES
    assert CL._ward_blocks(150_000, 600_000, 64) == (3, 11)  # 16 blocks and four before: each row of the table four times


def test_wide_buckets_are_compared_as_one_table(spark):
    """At a low threshold most pairs share a bucket of several tables: rows are dealt out once, the pairs are the same."""
    from pyspark.sql import functions as F
    X = rng.normal(size=(300, 16))
    df = _vec_df(spark, X)
    got = {(r.a, r.b): r.cosine for r in CJ.similar_pairs_lsh(df, 0.3).collect()}
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if U[i] @ U[j] >= 0.3}
    assert set(got) <= want and len(got) >= 0.999 * len(want) and all(abs(got[i, j] - U[i] @ U[j]) < 1e-9 for i, j in got)
    rows = df.select("id", F.col("embedding").alias("v"), F.array(*(F.lit(0).cast("long"),) * 16).alias("keys"))
    wide = CJ._bucket_blocks(rows, 300, 1024, 1024).collect()
    assert len(wide) == 300 and {r.t for r in wide} == {-1}
    rows = df.select("id", F.col("embedding").alias("v"), F.array(*(F.col("id"),) * 16).alias("keys"))
    assert {(r.t, r.key) for r in CJ._bucket_blocks(rows, 300, 1024, 1024).collect()} == {(t, k) for t in range(16) for k in range(300)}
