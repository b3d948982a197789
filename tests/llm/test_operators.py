"""Each operator against a brute-force version on hand-made rows, the odd cases among them."""

import hashlib
import heapq
import random
import re
import string
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import chunks, decontaminate, lines, links, mix, pii, quality, simhash, substrings, suffixes, urls
from tests.llm.conftest import SCHEMA, edge_rows, prose, rows_of

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BIG = 1 << 63


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 1 SimHash -----------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[find(k)]) for k, ((i, _), f) in enumerate(zip(rows, fp))), key=repr)


def test_simhash_edge(edge):
    want = brute_components([(r[0], r[1]) for r in edge_rows()])
    assert rows_of(simhash.simhash_groups(edge), "doc_id", "fingerprint", "component_id") == want


def test_simhash_empty_and_clashing(empty, clashing):
    assert simhash.simhash_groups(empty).collect() == []
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    groups = brute_components([(r[0], r[1]) for r in edge_rows()])
    n = len({(c, f if c is None else None) for _, f, c in groups})
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == n and {g for g in got if g is not None} <= {c for _, _, c in groups}
    assert rows_of(kept.filter("doc_id = 3"), "rid", "`with.dot`") == [("own rid", 1)]


def test_links_connect_all_pairs_within_three_bits(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(-2**63, 2**63 - 1, 30)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= int(np.array(1 << int(b), np.uint64).view(np.int64))
            fps.add(x)
    f = np.array(sorted(fps))
    near = np.bitwise_count((f[:, None] ^ f[None, :]).view(np.uint64)) <= 3
    label = np.arange(len(f))
    for _ in range(len(f)):
        new = np.where(near, label[None, :], len(f)).min(axis=1)
        if (new == label).all():
            break
        label = new
    want = f[label]
    nodes = spark.createDataFrame([(int(x),) for x in f], "fp long").repartition(4)
    for group_rows in (4096, 7):  # the latter cuts anchor groups into blocks
        e = simhash.links(nodes, 3, group_rows)
        assert e.count() < 8 * len(f)  # all pairs are many more with denser groups; each anchor gives a forest
        got = {r.node: r.root for r in links.components(e).collect()}
        assert [got.get(x, x) for x in f.tolist()] == want.tolist()


def test_components_of_a_chain_and_a_star(spark, monkeypatch):
    made = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 4999)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(made, "u long, v long")).collect()}
    assert set(got.values()) == {0, 1000, 4999} and len(got) == 301 + 201 + 2
    for name, value in (("HOT_ROWS", 16), ("HOT_SHARE", 10)):  # the star's hub and the pair's are split off
        monkeypatch.setattr(links, name, value)
    made += [(7000 - i, 8000) for i in range(150)] + [(8000, 8001), (8001, 8002)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(made, "u long, v long")).collect()}
    assert set(got.values()) == {0, 1000, 4999, 6851} and len(got) == 301 + 201 + 2 + 153


# --- 2 decontamination ---------------------------------------------------------------------------
def brute_contamination(docs, items):
    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k:k + 13])].add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def items_of(spark):
    rows = edge_rows()
    texts = [(1, rows[17][1]), (10, "Été ÜBER, 日本 éTé"), (2, None), (3, ""), (4, "one"), (None, "two! WORDS"), (1, rows[0][1]), (5, rows[17][1] + " more")]
    return texts, spark.createDataFrame([(*t, "x") for t in texts], "item_id long, text string, doc_id string")


def test_decontaminate_edge(spark, edge):
    texts, benchmark = items_of(spark)
    want = brute_contamination([(r[0], r[1]) for r in edge_rows()], texts)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert any(r[2] for r in want) and rows_of(decontaminate.report(edge, benchmark), *columns) == want
    blocks = decontaminate.hits(edge, benchmark, block_bytes=300)
    assert rows_of(blocks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n")), "doc_id", "n_words", "n_hit", "n") == sorted((r[:4] for r in want), key=repr)


def test_decontaminate_empty_and_clashing(spark, edge, empty, clashing):
    texts, benchmark = items_of(spark)
    assert decontaminate.report(empty, benchmark).collect() == []
    assert decontaminate.report(edge, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    kept = decontaminate.clean(clashing, benchmark)
    want = brute_contamination([(r[0], r[1]) for r in edge_rows()], texts)
    assert kept.columns == clashing.columns and kept.count() == sum(not r[5] for r in want)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    for n, v in ((1, 1), (50, 1), (400, 2), (900, 30)):
        text = np.append(rng.integers(0, v + 1, n), 0)
        index = decontaminate.Index(text)
        for m in (1, 2, 5):
            p = rng.integers(1, v + 1, (20, m))
            which, at = index.search(p)
            want = {(k, i) for k in range(20) for i in range(len(text) - m + 1) if (text[i:i + m] == p[k]).all()}
            assert set(zip(which.tolist(), at.tolist())) == want and len(at) == len(want)


# --- 3 quality -----------------------------------------------------------------------------------
def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = quality.classify(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(r) > 500 and ((r.score >= 0) & (r.score <= 1)).all() and (r.predicted == (r.score >= 0.3)).all()
    good, bad = r.score[r.quality == 1], r.score[r.quality == 0]
    assert np.mean(good.values[:, None] > bad.values[None, :]) > 0.98
    assert (r.predicted[r.quality == 1] == 1).mean() > 0.98 and (r.predicted[r.quality == 0] == 0).mean() > 0.8


def test_quality_learns_nothing_from_the_held_out_fold(spark, edge):
    import zlib
    ids = [i for i in range(18)]
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, "own") for i in ids] + [(None, 1, "x"), (4, None, "x"), (999, 0, "x")], "doc_id long, quality int, score string")
    flipped = spark.createDataFrame([(i, (1 if i % 2 else 0) ^ (zlib.crc32(str(i).encode()) % 5 == 0), "own") for i in ids], "doc_id long, quality int, score string")
    one, two = (rows_of(quality.classify(edge, x).withColumn("score", F.round("score", 9)), "doc_id", "held_out", "score", "predicted") for x in (labels, flipped))
    assert one == two and len(one) == len(edge_rows())
    assert {(r[0], r[1]) for r in one} == {(r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in edge_rows()}


def brute_quality(model, texts):
    """Terms counted one by one, all cosines, a full sort, and the weighted votes."""
    rows = []
    for t in texts:
        b = (t or "").encode()
        c = Counter((((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1) % 2 ** 32) >> 21 for i in range(len(b) - 2))
        x = np.zeros(quality.TERMS)
        for k, n in c.items():
            x[k] = n
        x[quality.HASHED:] = quality.term_counts(b)[quality.HASHED:]
        x = np.log1p(x) * model.idf
        rows.append(x / max(np.linalg.norm(x), 1e-12))
    z = np.array(rows) @ model.axes.astype(float)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    out = []
    for cos in np.round(z @ model.vectors.T.astype(float), 6):
        near = sorted(range(len(cos)), key=lambda j: (-cos[j], j))[:quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0) ** 4
        out.append((w @ model.labels[near] + quality.PRIOR_WEIGHT * model.prior) / (w.sum() + quality.PRIOR_WEIGHT))
    return np.array(out)


def test_quality_against_brute_force(spark, edge):
    """500 documents of sf0.01 and the edge rows; single swaps of neighbours whose cosines differ by rounding are let pass."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(d, labels)
    texts = [r.text for r in d.orderBy("doc_id").limit(500).collect()] + [r[1] for r in edge_rows()]
    want = brute_quality(model, texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = np.array([r.score for r in sorted(quality.score(rows, model).collect())])
    assert (abs(got - want) < 1e-4).mean() > 0.99 and (abs(got - want) < 0.15).all()


def test_quality_axes_hold_the_energy_of_the_exact_ones():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 20)) * np.geomspace(8, 1, 20) @ rng.standard_normal((20, 500)) + rng.standard_normal((300, 500))).astype(np.float32)
    got = quality.top_axes(x, 16)
    s = np.linalg.svd(x.astype(float), compute_uv=False)
    assert np.allclose(got.T @ got, np.eye(16), atol=1e-3) and ((x @ got) ** 2).sum() > 0.999 * (s[:16] ** 2).sum()
    assert quality.top_axes(x[:5], 5).shape == (500, 5)


def test_quality_ties_and_repeats(spark):
    """The leftmost of equal columns vote; a labelled doc_id's rows count once, whatever their order."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        cos = rng.integers(0, 4, (7, 400)) / 8
        want = np.sort(np.argsort(-cos, axis=1, kind="stable")[:, :15], axis=1)
        assert (quality.nearest(cos, 15) == want).all()
    texts = [prose(random.Random(k), 30) for k in range(30)]
    rows = [(k % 20, t, "en", "s", 1) for k, t in enumerate(texts)] + [(3, None, "en", "s", 1)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(4, 1), (4, 0)], "doc_id long, quality int")
    one, two = (rows_of(quality.classify(spark.createDataFrame(r, SCHEMA).repartition(n), labels), "doc_id", "score") for r, n in ((rows, 1), (rows[::-1], 7)))
    assert np.allclose([s for _, s in one], [s for _, s in two], atol=1e-5)


def test_quality_empty_and_clashing(edge, empty, clashing):
    labels = edge.select("doc_id", F.lit(1).alias("quality"))
    assert quality.classify(empty, labels).collect() == []
    assert {r.score for r in quality.classify(edge, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == len(edge_rows())


# --- 4 suffixes ----------------------------------------------------------------------------------
def brute_bytes(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    c = Counter(t[k:k + 200] for _, t in texts for k in range(len(t) - 199))
    out = []
    for i, t in texts:
        flags = [False] * len(t)
        for k in range(len(t) - 199):
            if c[t[k:k + 200]] > 1:
                flags[k:k + 200] = [True] * 200
        spans = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        kept = bytes(x for x, f in zip(t, flags) if not f)
        out.append((i, len(t), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [suffixes.HOT, 300])
def test_suffixes_edge(edge, hot):
    want = brute_bytes([(r[0], r[1]) for r in edge_rows()])
    got = suffixes.dedup_suffixes(edge, hot).withColumn("sha", F.sha2("kept", 256))
    assert sum(r[2] for r in want) and rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == want


def test_suffixes_many_contexts(spark, empty, clashing, monkeypatch):
    """Passages of about the window's length in changing surroundings: the transforms decide."""
    import random
    rng = random.Random(9)
    passages = ["".join(rng.choice("ab c") for _ in range(n)) for n in (199, 200, 201, 260, 450)]
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 300)))
        for p in rng.sample(passages, 2):
            a = rng.randrange(0, 30)
            t += p[a:] + "".join(rng.choice("xyz ") for _ in range(rng.randrange(0, 90)))
        rows.append((i, t, None, None, None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_bytes([(r[0], r[1]) for r in rows])
    assert rows_of(suffixes.report(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffixes.report(empty).collect() == [] and suffixes.report(clashing).count() == len(edge_rows())


def test_merge_of_small_shards_is_one_sort(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 2000).astype(np.uint8).tobytes()
    segs = [base[s:s + 400] for s in rng.integers(0, 1600, 40).tolist()]
    monkeypatch.setattr(suffixes, "SHARD", 1500)
    got = suffixes.repeated_starts(segs, [201] * 40, [1] * 40)
    c = Counter(t[k:k + 200] for t in segs for k in range(201))
    assert [f.tolist() for f in got] == [[c[t[k:k + 200]] > 1 for k in range(201)] for t in segs]


# --- 5 personal data -----------------------------------------------------------------------------
PII_TEXTS = [
    "mail me: a.b@c.de, x@y, @z.com é@f.g.h a@b.c@d.e u@v.w_q@r.s", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.255 999999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111", "tel +1 (212) 555-0100. or +49 30 1234567 9 +1", "+12345678901234567 +1-2-3",
    "IBAN DE89 3704 0044 0532 0130 00 bad DE88 3704 0044 0532 0130 00 ok GB82WEST12345698765432", "ssn 123-45-6789 or 123-45-6780", "123-45-6789",
    "日本 a@b.co 日本 +81 90 1234 5678", "9" * 3000, "a" * 5000 + "@x.y", "." * 3000, "a@b.c " * 1500, "", None]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    t, out = text or "", []
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                                   ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d))
                    or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_base_spans(spark, edge):
    texts = PII_TEXTS + [r[1] for r in edge_rows()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.report(df).collect():
        want = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE] == want


def test_pii_added_spans(spark, empty):
    texts = PII_TEXTS[5:8]
    got = [r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    found = [[texts[i][int(s):int(e)] for k, s, e in (x.split(":") for x in g.split(",") if x) if k in pii.ADDED] for i, g in enumerate(got)]
    assert found == [["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], ["123-45-6789"], []] or found[0][0].startswith("DE89")
    assert pii.report(empty).collect() == []


# --- 6 URLs --------------------------------------------------------------------------------------
def test_urls(spark):
    bits = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/1", "x://example.com/en/", "http://a.example.com/en/?q", "http://example.com/en",
            "http://example.com?x=/en/", "http://a.net/es/1#f", "http://net/fr/", "http://b.net/frx", "http://com", "http://com/", "http://évil.com/é",
            "http://a.org/x.com/", "http://ads.org/", "http://a.org/b/login?x", "http://a.org/" + "y" * 9000 + ".exe", "http://wwwexample.com/en/", "http://a.com:80/en/", "a://b://c.com/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(bits)], "page_id long, url string, host string, rule string")
    order = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    for r in urls.judge(df).collect():
        u = bits[r.page_id] or ""
        m = re.search(r"://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = next((x for x in order if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])), None)
        junk = any(re.fullmatch(re.escape(g).replace(r"\*\*", "(?s:.*)").replace(r"\*", "[^/]*"), host + path) for g in urls.JUNK)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit and fit[1] + fit[2], fit[0] if fit else "block" if junk else "allow"), u
    assert urls.judge(df.limit(0)).collect() == [] and {r.rule for r in urls.judge(df, rules=()).collect()} == {None}


# --- 7 chunks ------------------------------------------------------------------------------------
def test_cuts_are_the_plain_rolling_rule():
    rng = np.random.default_rng(4)
    for n in (0, 1, 23, 24, 48, 300, 5000):
        t = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        h, hashes = 0, []
        for c in t:
            h = (h * 2 + int(chunks.GEAR[c])) & 0xFFFFFFFF
            hashes.append(h)
        want, start = [], 0
        while start < n:
            end = start + chunks.SHORTEST
            while end < min(n, start + chunks.LONGEST) and hashes[end - 1] & int(chunks.STRICT if end < start + chunks.NORMAL else chunks.LOOSE):
                end += 1
            end = min(end, n)
            want.append(end)
            start = end
        assert chunks.cuts(t) == want
    chunks_before, whole = chunks.PIECE, chunks.cuts(t)
    chunks.PIECE = 700
    try:
        assert chunks.cuts(t) == whole
    finally:
        chunks.PIECE = chunks_before


def test_edited_report(edge, empty, spark):
    rows = sorted(((r[0], r[1] or "") for r in edge_rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        a, b, c = (chunks.chunk_set(x.encode()) for x in (t, e, nxt))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), chunks.encode(a), chunks.encode(b), chunks.likeness(a, b), chunks.likeness(a, c)))
    got = chunks.edited_report(edge)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert chunks.edited_report(empty).collect() == []
    alone = chunks.edited_report(spark.createDataFrame([(1, "only one text here, of some length " * 9)], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    assert chunks.fingerprints(edge).count() == len(rows)


def test_insertion_changes_few_chunks():
    t = prose(__import__("random").Random(3), 3000).encode()
    a, b = chunks.chunk_set(t), chunks.chunk_set(t[:5000] + b"inserted " + t[5000:])
    assert chunks.likeness(a, b) > 0.97 and chunks.likeness(a, a) == 1


# --- 8 substrings --------------------------------------------------------------------------------
def brute_substrings(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, BIG), BIG if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < (BIG if i is None else i):
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("first", [2, 7, 13])
def test_substrings_edge(edge, first):
    want = brute_substrings([(r[0], r[1]) for r in edge_rows()])
    got = substrings.dedup_substrings(edge, first=first).withColumn("sha", F.sha2("text", 256))
    assert sum(r[2] for r in want) and rows_of(got, "doc_id", "n_words", "n_removed", "sha") == want


def test_substrings_empty_and_clashing(empty, clashing, edge):
    assert substrings.report(empty).collect() == []
    got = substrings.dedup_substrings(clashing)
    assert got.columns == [c for c in clashing.columns if c != "n_removed"] + ["n_words", "n_removed"]
    assert rows_of(got, "doc_id", "n_removed") == rows_of(substrings.dedup_substrings(edge), "doc_id", "n_removed")


def test_substrings_passages_in_many_documents(spark):
    import random
    rng = random.Random(11)
    passages = [prose(rng, n, 50) for n in (12, 13, 14, 40)]
    rows = [(rng.randrange(40), prose(rng, rng.randrange(0, 30), 1000) + " " + rng.choice(passages) + " " + prose(rng, 8, 1000) + " " + rng.choice(passages)) for _ in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(substrings.report(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


# --- 9 mix ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("period,block", [(16, 1), (256, 3), (7, 2)])
def test_mix_deviates_by_less_than_a_block(spark, edge, period, block):
    r = mix.schedule(edge.drop("text"), period=period, block_rows=block).collect()
    assert len(r) == len(edge_rows())
    share = {x.source: x.share for x in mix.sqrt_shares(edge, period).collect()}
    assert sum(share.values()) == period
    served = defaultdict(set)
    for x in r:
        served[x.source].add((x.slot, x.block))
        assert x.release <= x.slot < x.deadline and 0 <= x.row_in_block < block
    slots = [s for v in served.values() for s, _ in v]
    assert len(slots) == len(set(slots))
    gap = min((x.slot for x in r if not x.on_target), default=None)
    for t in range(1, (gap if gap is not None else max(slots)) + 1):
        for src, v in served.items():
            assert abs(sum(s < t for s, _ in v) - t * share[src] / period) < 1
    for src in served:
        mine = sorted((x.block, x.row_in_block) for x in r if x.source == src)
        assert mine == [(k // block, k % block) for k in range(len(mine))]


def test_mix_given_shares_and_errors(spark, edge, empty):
    shares = spark.createDataFrame([("src0", 5), ("src1", 1), ("src2", 1), (None, 1)], "source string, share long")
    r = mix.schedule(edge, shares, period=8, block_rows=2)
    assert r.count() == len(edge_rows()) and r.columns == [*edge.columns, *mix.ADDED]
    assert mix.schedule(empty).collect() == []
    with pytest.raises(Exception, match="shares must be whole"):
        mix.schedule(edge, shares, period=9).collect()
    with pytest.raises(Exception, match="shares must be whole"):
        mix.schedule(edge, shares.filter("source is not null"), period=7).collect()


def test_mix_cuts_hot_sources_into_pieces(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"), F.lit("own").alias("slot"))
    whole = rows_of(mix.schedule(df), "doc_id", "slot", "block")
    monkeypatch.setattr(mix, "PIECE_ROWS", 20)
    assert rows_of(mix.schedule(df), "doc_id", "slot", "block") == whole


def test_mix_plan_is_native(edge):
    plan = mix.schedule(edge)._jdf.queryExecution().executedPlan().toString() + pii.report(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def earliest_deadline_first(share, period):
    """source -> slots, by a heap."""
    names = sorted(share, key=lambda x: (x is not None, x or ""))
    released, heap, out = defaultdict(list), [], defaultdict(list)
    for i, s in enumerate(names):
        for j in range(share[s]):
            released[j * period // share[s]].append((-(-(j + 1) * period // share[s]), i, s))
    for t in range(period):
        for x in released[t]:
            heapq.heappush(heap, x)
        out[heapq.heappop(heap)[2]].append(t)
    return out


def test_mix_shares_follow_the_square_root(spark):
    df = spark.range(29_800).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10_000, "big").otherwise(
        F.concat(F.lit("s"), F.col("id") % 198)).alias("source"))
    got = {r.source: r for r in mix.sqrt_shares(df).collect()}
    period = sum(r.share for r in got.values())
    roots = sum(r.rows ** 0.5 for r in got.values())
    assert len(got) == 199 and all(abs(r.share - period * r.rows ** 0.5 / roots) < 1 and r.share >= mix.LEAST for r in got.values())
    # in a given period a source below one slot gets one, and the others the rest in proportion
    assert sorted(r.share for r in mix.sqrt_shares(df, 200).collect()) == [1] * 198 + [2]


@pytest.mark.parametrize("n", [2, 30, 300])
def test_mix_of_any_number_of_sources(spark, n):
    sizes = [200, *(1 + i % 7 for i in range(n - 1))]
    df = spark.createDataFrame([(k * 1000 + i, f"s{k:03}" if k != 1 else None) for k, m in enumerate(sizes) for i in range(m)], "doc_id long, source string")
    share = {r.source: r.share for r in mix.sqrt_shares(df).collect()}
    period = sum(share.values())
    want = earliest_deadline_first(share, period)
    r = mix.schedule(df, block_rows=1).collect()
    assert len(r) == len({x.slot for x in r}) == sum(sizes) and (n < 300 or period > mix.FOLD)
    assert all(x.slot == x.block // share[x.source] * period + want[x.source][x.block % share[x.source]] and x.release <= x.slot < x.deadline for x in r)


@pytest.mark.parametrize("shares", [[1, 1, 1], [5, 1, 1, 1], [60, 2, 1, 1, 1, 30, 30], [1] * 40 + [57, 3]])
def test_mix_rounds_equal_the_fold(spark, monkeypatch, shares):
    given = spark.createDataFrame([(f"s{i:02}" if i else None, x) for i, x in enumerate(shares)], "source string, share long")
    fold = rows_of(mix.one_period(given, sum(shares)), "source", "share", "j", "t")
    monkeypatch.setattr(mix, "FOLD", 1)
    assert rows_of(mix.one_period(given, sum(shares)), "source", "share", "j", "t") == fold and len(fold) == sum(shares)
    with pytest.raises(Exception, match="shares must be whole"):
        mix.one_period(given, sum(shares) + 1).collect()


@pytest.mark.parametrize("sizes", [(3000, 400, 90, 12, 1), (700,), (64, 65, 1000, 2000, 3, 500)])
def test_mix_equals_its_sql_on_unequal_sources(spark, sizes):
    rows, i = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, None if k == 1 else f"s{k}"))
            i += 1
    got = mix.report(spark.createDataFrame(rows, "doc_id long, source string").repartition(4)).toPandas()
    con = duckdb.connect()
    con.register("d", pd.DataFrame(rows, columns=["doc_id", "source"]))
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, source FROM d")
    want = con.execute(mix.ORACLE).df()
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].fillna("null").astype(object).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


# --- 10 lines ------------------------------------------------------------------------------------
def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def brute_lines(rows):
    """rows in order of doc_id, no equal ids."""
    seen, out = [], []
    known = set()
    for i, t in rows:
        kept, gone = [], 0
        parts = (t or "").split("\n")
        for line in parts:
            w = words(line.translate(LOWER))
            near = w and (tuple(w) in known or len(w) >= lines.NEAR_WORDS and any(len(x) >= lines.NEAR_WORDS and abs(len(x) - len(w)) < 2 and edit_distance(x, w) < 2 for x in seen))
            if w and tuple(w) not in known:
                known.add(tuple(w)), seen.append(w)
            if near:
                gone += 1
            else:
                kept.append(line)
        out.append((i, len(parts) if t else 0, gone, "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    import random
    rng = random.Random(21)
    stock = [prose(rng, n, 30).split() for n in (3, 4, 5, 6, 9, 10, 12, 25, 40)]
    rows = []
    for i in range(50):
        ls = []
        for _ in range(rng.randrange(0, 6)):
            w = list(rng.choice(stock))
            for _ in range(rng.randrange(0, 3)):
                k, op = rng.randrange(len(w)), rng.randrange(3)
                w[k:k + (op != 0)] = [] if op == 2 else [f"n{rng.randrange(6)}"]
            ls.append(rng.choice(("", "  ")) + " ".join(w).replace("w1", rng.choice(("w1", "W1"))))
        rows.append((i, "\n".join(ls) if rng.random() < 0.9 else None))
    return rows


def test_lines(spark):
    rows = line_rows()
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).withColumn("text", F.coalesce("text", F.lit("")))
    want = brute_lines(rows)
    assert sum(r[2] for r in want) > 20 and rows_of(got, "doc_id", "n_lines", "n_removed", "text") == want


def test_lines_edge(edge, empty, clashing):
    assert lines.report(empty).collect() == []
    got = lines.dedup_lines(clashing)
    assert got.columns == [c for c in clashing.columns if c != "n_removed"] + ["n_lines", "n_removed"] and got.count() == len(edge_rows())
    # of the equal rows all but the first lose their lines
    assert sorted(r.n_removed for r in got.filter("doc_id = 3").collect()) == [0, 3, 3]
    assert {r.text for r in got.filter("n_lines = 0").collect()} <= {None, ""}


def test_lines_beyond_eight_million(spark):
    n = (1 << 23) + 1
    docs = [(0, "a b c"), (1, "\n" * n + "a b c"), (2, "d e f\ng h i"), (3, "j")]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_lines", "n_removed", F.sha2("text", 256)) == [
        (i, len(t.split("\n")), int(i == 1), hashlib.sha256((t if i != 1 else "\n" * (n - 1)).encode()).hexdigest()) for i, t in docs]
    assert [lines.line_bits(x) for x in (0, 1, 1 << 32, (1 << 32) + 1)] == [31, 31, 31, 30]
