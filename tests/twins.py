"""Sequential twins that the distributed clustering jobs are held against."""

import math

import numpy as np
import pandas as pd


def leaf_clusters_local(n_ids: np.ndarray, edges: pd.DataFrame, m: int):
    """Leaf clusters of the condensed tree from MST edges (ascending weight, ties by (u, v)).

    Union-find with per-component state: size, pure/split, member list start,
    the weight at which each member joined its current leaf lineage.
    Returns (labels frame, condensed-tree frame).
    """
    idx = {int(x): i for i, x in enumerate(n_ids)}
    n = len(n_ids)
    parent = list(range(n))
    size = [1] * n
    pure = [False] * n          # is a cluster (size ≥ m) with no true split inside
    split = [False] * n
    members = [[i] for i in range(n)]
    join_w = [None] * n         # weight at which the point joined its (pure) lineage
    birth = [None] * n          # seed weight of a pure component
    label = [-1] * n
    prob = [0.0] * n
    outl = [1.0] * n
    tree = []
    next_cluster = [0]

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def close(c, w):
        cid = next_cluster[0]
        next_cluster[0] += 1
        b = birth[c]
        for p in members[c]:
            label[p] = cid
            jw = join_w[p]
            if b == 0:
                prob[p] = 1.0 if jw == 0 else 0.0
            else:
                prob[p] = b / jw if jw else 1.0
            outl[p] = 1.0 - prob[p]
        tree.append((-1, cid, (1.0 / w) if w else math.inf, len(members[c])))

    e = edges.sort_values(["w", "u", "v"], kind="mergesort")
    for u, v, w in zip(e["u"], e["v"], e["w"]):
        a, b = find(idx[int(u)]), find(idx[int(v)])
        if a == b:
            continue
        big_a, big_b = size[a] >= m, size[b] >= m
        if big_a and big_b:
            for c in (a, b):
                if pure[c]:
                    close(c, w)
            newsplit = True
            newpure = False
        elif big_a or big_b:
            big, small = (a, b) if big_a else (b, a)
            if pure[big]:
                for p in members[small]:
                    join_w[p] = w
                newpure, newsplit = True, False
            else:
                for p in members[small]:
                    outl[p] = 1.0
                newpure, newsplit = False, True
        else:
            if size[a] + size[b] >= m:
                for p in members[a] + members[b]:
                    join_w[p] = w
                newpure, newsplit = True, False
            else:
                newpure, newsplit = False, False
        r, o = (a, b) if size[a] >= size[b] else (b, a)
        parent[o] = r
        if newpure and not (pure[a] or pure[b]):
            birth[r] = w
        elif newpure:
            birth[r] = birth[a] if pure[a] else birth[b]
        size[r] += size[o]
        members[r] = members[r] + members[o] if (newpure or not newsplit) else []
        members[o] = []
        pure[r], split[r] = newpure, newsplit
    labels = pd.DataFrame({"id": n_ids.astype("int64"), "cluster_id": np.array(label, dtype="int32"),
                           "cluster_probability": np.array(prob, dtype="float64"),
                           "outlier_score": np.array(outl, dtype="float64")})
    tr = pd.DataFrame(tree, columns=["parent", "child", "lambda_val", "child_size"]) if tree else \
        pd.DataFrame({"parent": pd.Series([], dtype="int64"), "child": pd.Series([], dtype="int64"),
                      "lambda_val": pd.Series([], dtype="float64"), "child_size": pd.Series([], dtype="int64")})
    return labels, tr


def merge_small_walk(ids, n, s, min_size):
    """The clusters below ``min_size``, one after another in ascending id, join the nearest centroid."""
    n = {int(i): float(c) for i, c in zip(ids, n)}
    s = {int(i): np.array(v, dtype=float) for i, v in zip(ids, s)}
    target = {i: i for i in n}
    for c in sorted(n):
        if n[c] >= min_size:
            continue
        best, least = -1, math.inf
        for o in sorted(n):
            if o != c and n[o] > 0:
                d = float(np.linalg.norm(s[c] / n[c] - s[o] / n[o]))
                if d < least:
                    best, least = o, d
        target[c] = best
        if best != -1:
            n[best], s[best] = n[best] + n[c], s[best] + s[c]
        n[c] = 0
    out = {}
    for c in target:
        x = c
        while x != -1 and target[x] != x:
            x = target[x]
        out[c] = x
    return out


def condensed_tree_walk(edges, m):
    """The condensed hierarchy by taking the spanning tree's edges in order; rows
    (size, lambda, stability, is_leaf, size and lambda of the parent)."""
    ids = {x for u, v, _ in edges for x in (u, v)}
    comp = {x: x for x in ids}
    size, node, nodes = dict.fromkeys(ids, 1), dict.fromkeys(ids), []

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for u, v, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        a, b = find(u), find(v)
        lam = 1 / w if w else math.inf
        if node[a] and node[b]:
            top = {"own": 0, "left": 0.0, "kids": size[a] + size[b], "end": lam, "up": None}
            for c in (a, b):
                node[c].update(up=top, size=size[c], lam=lam)
            nodes.append(top)
        elif node[a] or node[b]:
            top, small = (node[a], b) if node[a] else (node[b], a)
            top["own"] += size[small]
            top["left"] += size[small] * lam
        elif size[a] + size[b] >= m:
            top = {"own": size[a] + size[b], "left": (size[a] + size[b]) * lam, "kids": 0, "end": 0.0, "up": None}
            nodes.append(top)
        else:
            top = None
        comp[b] = a
        size[a] += size[b]
        node[a] = top
        if top is not None and top["up"] is None:
            top.update(size=size[a], lam=0.0)
    for x in nodes:
        x["stability"] = x["left"] + x["kids"] * x["end"] - x["size"] * x["lam"]
    if len(nodes) == 1:
        return []
    return sorted((x["size"], x["lam"], x["stability"], x["kids"] == 0, x["up"]["size"] if x["up"] else -1, x["up"]["lam"] if x["up"] else -1.0) for x in nodes)
