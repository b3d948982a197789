"""Hard negatives against a brute-force version with Python integers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import negatives
from tests.llm.conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"
OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_strassen_is_exact_modulo_two_to_the_64():
    rng = np.random.default_rng(3)
    for shape in ((1, 1, 1), (5, 3, 7), (33, 17, 65), (64, 64, 64), (0, 4, 5), (70, 0, 20)):
        for top in (300, 2 ** 62):
            a, b = rng.integers(-top, top, shape[:2]), rng.integers(-top, top, shape[1:])
            want = a.astype(object) @ b.astype(object) if shape[1] else np.zeros((shape[0], shape[2]), object)
            got = negatives.strassen(a, b, 4)
            assert got.shape == (shape[0], shape[2])
            assert all((int(x) - int(y)) % 2 ** 64 == 0 for x, y in zip(got.ravel(), want.ravel()))


def test_window_bounds():
    for p in list(range(-250, 251)) + [2 ** 63 - 1, -2 ** 63]:
        lo, hi = (int(x[0]) for x in negatives.window_of(np.array([p], np.int64), 80, 100))
        assert hi == p and (lo == -(-80 * p // 100) or p < -10 ** 18)


def brute(rows, positives=5, negatives_=5, low=80, high=100, step=100):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows
          if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for a, x, c in ok:
        if a is None or a % step:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, d) for i, y, d in ok]
        for s, p, _ in sorted((t for t in scored if t[2] == c and t[1] != a), key=key)[:positives]:
            bad = sorted((t for t in scored if t[2] != c and low * s <= 100 * t[0] <= high * s), key=key)[:negatives_]
            out += [(a, p, r, n, s, m) for r, (m, n, _) in enumerate(bad, 1)]
    return sorted(out, key=repr)


def made(n, seed):
    rng = random.Random(seed)
    base = [[rng.gauss(0, .5) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, .25) for x in base[rng.randrange(5)]]
        rows.append((i * 10 % 1000 + i // 100, v, rng.choice([0, 0, 0, 1, 2, 3])))
    rows += [(100, None, 1), (200, rows[0][1], None), (300, [1.0, float("nan")] + [0.0] * 4, 0), (400, [1.0, None] + [0.0] * 4, 0),
             (500, [float("inf")] * 6, 0), (None, rows[1][1], 0), (None, rows[2][1], 2), rows[0], rows[0], (0, rows[3][1], 1),
             (600, [], 1), (700, rows[4][1][:4], 0), (700, rows[4][1] + [2.0], 0)]
    rows += [(800 + k, rows[5][1], k % 3) for k in range(60)]  # ties
    return rows


def test_mine_edge_rows(spark, monkeypatch):
    rows = made(400, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 100 and any(r[3] is None for r in brute(rows, negatives_=100))
    anchor = F.col("vec_id") % 100 == 0
    assert rows_of(negatives.mine(df, anchor), *OUT) == want
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(negatives, "TILE_ROWS", 17)
    assert rows_of(negatives.mine(df, anchor), *OUT) == want
    assert rows_of(negatives.mine(df, anchor, 2, 3, 50, 90), *OUT) == brute(rows, 2, 3, 50, 90)


def test_mine_empty_clashing_and_huge(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.report(empty).collect() == []
    rows = [(i, [1e300, -1e300, float(i)], i % 2) for i in range(0, 400, 50)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0)
    assert got.columns == list(OUT) and got.collect() is not None  # beyond the range of a long, but defined
    rows = made(60, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    noisy = df.withColumns({c: F.lit(f"own {c}") for c in ("aid", "rid", "score", "rank", "block", "tile", "wins", "place", "v", "anchor", "anchor_id")})
    labels = [(i, v, (c + 1) % 10 if i is not None and c is not None and i % 7 == 0 else c) for i, v, c in rows]
    assert rows_of(negatives.report(noisy), *OUT) == brute(labels)
