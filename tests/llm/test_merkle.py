"""Merkle manifest against a tree built level by level."""

import random
import string
import zlib
from hashlib import sha256
from itertools import groupby

from gleaner.llm import merkle
from tests.llm.conftest import SCHEMA, edge_rows, rows_of

OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes):
    """Root, and for each node the (before, after) siblings of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            s = p // 16 * 16
            paths[k].append(("".join(nodes[s:p]), "".join(nodes[p + 1:s + 16])))
            at[k] = p // 16
        nodes = [h("".join(nodes[s:s + 16])) for s in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    key = lambda r: (r[3] is not None, (r[3] or "").encode())
    parts = []
    for _, g in groupby(sorted(rows, key=key), key):
        g = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in g), key=lambda t: t[:3])
        parts.append((g, *tree([t[2] for t in g])))
    root, tops = tree([p[1] for p in parts])
    out = []
    for (g, subroot, paths), top in zip(parts, tops):
        for (_, _, own, r), path in zip(g, paths):
            full = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            x = leaf(r, None if r[1] is None else r[1].translate(LOWER)) if bad else own
            for a, b in full:
                x = h(a + x + b)
            out.append((r[0], own, subroot, root, h("".join(a + b for a, b in full)), x, x == root))
    return sorted(out, key=repr)


def test_edge_rows_empty_and_clashing(spark, edge, empty, clashing):
    want = brute(edge_rows())
    assert rows_of(merkle.report(edge), *OUT) == want
    assert merkle.report(empty).collect() == []
    assert rows_of(merkle.report(clashing), *OUT) == want


def test_tiers_and_many_sources(spark):
    """A source of more than one block, its last block of one leaf; 300 sources; equal and null ids."""
    rng = random.Random(2)
    rows = [(i, f"Text {i}", "en", "big", i) for i in range(2 * 4096 + 1)]
    rows += [(rng.randrange(2000), f"T{k % 7}", None, f"s{rng.randrange(300)}", None) for k in range(1500)]
    rows += [(None, "x", None, None, None)] * 20 + [(7, "same", "en", "big", 1)] * 30
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows)
    assert {r[-1] for r in want} == {True, False}
    assert rows_of(merkle.report(df), *OUT) == want
    m = merkle.manifest(df).filter("doc_id = 5").collect()
    assert all(merkle.fold(r.leaf, [s.asDict() for s in r.path]) == r.root for r in m)


def test_appender_extends_witnesses():
    nodes = [h(str(i)) for i in range(16 * 16 + 3)]
    up = merkle.Appender(3)
    held = [up.append(x) for x in nodes]
    assert merkle.witness(*held[0])[0]["others"] == nodes[1:16] and len(merkle.witness(*held[0])) == 3  # its runs below are complete
    assert len(merkle.witness(*held[-1])) == 1  # its run is open
    root = up.finish()
    assert root == tree(nodes)[0] and all(merkle.fold(x, merkle.witness(*w)) == root for x, w in zip(nodes, held))
