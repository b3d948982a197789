"""Merkle manifest of a dataset with incremental witnesses.

Each row is a leaf; the leaves of a source, in ascending doc_id, form a tree of
``FAN`` children to a node, and the sources' subroots form one more such tree.

Leaves are dealt in aligned blocks of ``FAN ** LEVELS``. A block's task appends
its leaves one after another (``Appender``): a leaf gets a partial witness, its
place in the open run of the lowest level; when a run of siblings is complete it
becomes a node, appended to the run above, and every witness below is extended by
that run at once, since witnesses share the runs they pass through. Block roots
are appended to the blocks of the next tier in the same way, and the subroots to
the tree of sources, until one root is left. A tier has one row for 4,096 of the
tier below; a witness is its block's part followed by the parts above.

Texts are hashed where they are read and never shuffled. Positions come from one
range sort of the leaves' digests, so a source with most of the rows is many
blocks like any other.

Edge cases: a null value is hashed as ``-``, an empty text as ``0:``. Sources and
doc_ids that are null come first. Rows with equal doc_id follow each other by
leaf digest; equal rows are leaves of their own with equal digests. A source of
one row is its own subroot; a dataset of one source has its subroot as root.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_positions, materialize, partitions, prepare

FAN, LEVELS, TAMPER_STEP = 16, 3, 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    k = 0
    while FAN ** k < n:
        k += 1
    return k


@dataclass
class Run:
    """Siblings of one level; closed, it is the node at ``slot`` of the run ``above``."""
    nodes: list[str] = field(default_factory=list)
    above: "Run | None" = None
    slot: int = 0


class Appender:
    """Streaming appends to one aligned subtree of ``levels`` levels.

    ``open`` holds the incomplete run of each level. A witness is (run, slot):
    what lies above is filled in as the later siblings complete.
    """

    def __init__(self, levels: int):
        self.open = [Run() for _ in range(levels)]
        self.root: str | None = None

    def append(self, node: str, level: int = 0, below: Run | None = None) -> tuple[Run | None, int]:
        if level == len(self.open):
            self.root = node
            return None, 0
        run = self.open[level]
        slot = len(run.nodes)
        run.nodes.append(node)
        if below is not None:
            below.above, below.slot = run, slot
        if len(run.nodes) == FAN:
            self._complete(level)
        return run, slot

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], Run()
        self.append(digest(run.nodes), level + 1, run)

    def finish(self) -> str | None:
        """Closes the last, shorter runs from below; the subtree's root."""
        for level in range(len(self.open)):
            if self.open[level].nodes:
                self._complete(level)
        return self.root


def witness(run: Run | None, slot: int) -> list[dict]:
    """[{slot, nodes}] from the leaf's run to the top run: its siblings and its place among them."""
    out = []
    while run is not None:
        out.append({"slot": slot, "others": run.nodes[:slot] + run.nodes[slot + 1:]})
        run, slot = run.above, run.slot
    return out


def fold(leaf: str, path: list[dict]) -> str:
    """The root that a leaf and its witness lead to."""
    for step in path:
        leaf = digest(step["others"][:step["slot"]] + [leaf] + step["others"][step["slot"]:])
    return leaf


PATH = "array<struct<slot:int,others:array<string>>>"
ARROW_PATH = pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.list_(pa.string()))]))


def _value(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*(_value(F.col(c)) for c in COLUMNS[:-1]), _value(text)), 256)


def tampered() -> Column:
    """Rows whose text is changed before its leaf is hashed again."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPER_STEP == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, given): ``given`` is the leaf of the row as received (tampered, else the same)."""
    return docs.select(*COLUMNS).select(
        "doc_id", "source", leaf_of(F.col("text")).alias("leaf"),
        F.when(tampered(), leaf_of(F.translate("text", _UP, _LOW))).alias("_given")).select(
        "doc_id", "source", "leaf", F.coalesce("_given", "leaf").alias("given"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, node) by aligned blocks, in the order of their positions."""
    size = FAN ** LEVELS
    return (nodes.withColumn("block", F.floor(F.col("pos") / size)).repartition(partitions(nodes.sparkSession), "tree", "block")
            .sortWithinPartitions("tree", "pos"))


def _streams(batches, columns):
    """Rows sorted by (tree, pos) -> lists of the rows of one block."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns)):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _append_all(rows, n: int) -> tuple[list, str]:
    up = Appender(min(LEVELS, levels_of(n)))
    got = [up.append(r[3]) for r in rows]
    return got, up.finish()


def _roots(batches):
    """The root of each block: (tree, pos, n, node) of the next tier."""
    size = FAN ** LEVELS
    for rows in _streams(batches, ("tree", "block", "n", "node")):
        tree, block, n, _ = rows[0]
        yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int64()), "pos": pa.array([block], pa.int64()),
                                          "n": pa.array([-(-n // size)], pa.int64()), "node": [_append_all(rows, n)[1]]})


def _paths(batches):
    """(tree, pos, path) of each node within its block."""
    for rows in _streams(batches, ("tree", "block", "n", "node", "pos")):
        got, _ = _append_all(rows, rows[0][2])
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows[i:i + 256]], pa.int64()), pa.array([r[4] for r in rows[i:i + 256]], pa.int64()),
                pa.array([witness(*w) for w in got[i:i + 256]], ARROW_PATH)],
                ["tree", "pos", "path"])


def trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(tree, pos, n, node) -> the root of each tree (tree, node), and the paths
    (tree, pos, path) of all first-tier block roots up to it (None: every tree is one block)."""
    size = FAN ** LEVELS
    tier = materialize(_blocks(nodes).mapInArrow(_roots, "tree long, pos long, n long, node string"), "block_roots")
    tiers = [tier]
    while tier.filter("n > 1").limit(1).count():
        tier = materialize(_blocks(tier).mapInArrow(_roots, "tree long, pos long, n long, node string"), "block_roots")
        tiers.append(tier)
    paths = None
    for t in reversed(tiers[:-1]):
        own = _blocks(t).mapInArrow(_paths, f"tree long, pos long, path {PATH}")
        if paths is not None:
            above = paths.select("tree", F.col("pos").alias("block"), F.col("path").alias("more"))
            own = own.withColumn("block", F.floor(F.col("pos") / size)).join(above, ["tree", "block"]).select(
                "tree", "pos", F.concat("path", "more").alias("path"))
        paths = materialize(own, "block_paths")
    return tiers[-1].select("tree", "node"), paths


def _finish(batches):
    """Rows of a block after one with the path above it -> the full witness of each row."""
    cols = ("tree", "block", "n", "node", "doc_id", "given", "subroot", "root", "above")
    for (lead, *rows) in _streams(batches, cols):
        subroot, root, above = lead[6:]
        got, _ = _append_all(rows, rows[0][2])
        for i in range(0, len(rows), 64):
            part = rows[i:i + 64]
            k = len(part)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[4] for r in part], pa.int64()), pa.array([r[3] for r in part]), pa.array([r[5] for r in part]),
                pa.array([subroot] * k), pa.array([root] * k), pa.array([witness(*w) + above for w in got[i:i + 64]], ARROW_PATH)],
                ["doc_id", "leaf", "given", "subroot", "root", "path"])


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, given, subroot, root, path) of every row; ``path`` is its whole witness,
    from its run of leaves through the subroots to the root."""
    spark = docs.sparkSession
    prepare(spark)
    size = FAN ** LEVELS
    found = materialize(leaves(docs).withColumn("_i", F.monotonically_increasing_id()), "leaves")
    order = (F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "_i")
    placed = materialize(dense_positions(found, "leaf_order", *order), "placed")
    # of the sources only what is one row for each: their number, first place and size
    sizes = placed.groupBy("source").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    sources = materialize(dense_positions(sizes, "source_order", F.col("source").asc_nulls_first()).withColumnRenamed("pos", "tree"), "sources")
    nodes = materialize(placed.join(sources, placed.source.eqNullSafe(sources.source)).select(
        "tree", (placed.pos - F.col("start")).alias("pos"), "n", F.col("leaf").alias("node"), "doc_id", "given"), "nodes")
    subroots, inner = trees(nodes.select("tree", "pos", "n", "node"))
    count = sources.count()
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "node")
    roots, outer = trees(top)
    own = _blocks(top).mapInArrow(_paths, f"tree long, pos long, path {PATH}").select("pos", F.col("path").alias("top"))
    if outer is not None:
        own = own.withColumn("block", F.floor(F.col("pos") / size)).join(
            outer.select(F.col("pos").alias("block"), "path"), "block").select("pos", F.concat("top", "path").alias("top"))
    above = own.withColumnRenamed("pos", "tree").join(subroots.withColumnRenamed("node", "subroot"), "tree")
    blocks = nodes.select("tree", F.floor(F.col("pos") / size).alias("block")).distinct()
    if inner is None:
        above = blocks.join(above, "tree").select("tree", "block", "subroot", F.col("top").alias("above"))
    else:
        none = F.expr(f"cast(array() as {PATH})")
        above = (blocks.join(above, "tree").join(inner.withColumnRenamed("pos", "block"), ["tree", "block"], "left")
                 .select("tree", "block", "subroot", F.concat(F.coalesce("path", none), "top").alias("above")))
    above = above.crossJoin(F.broadcast(roots.select(F.col("node").alias("root"))))  # one row
    # each block's rows follow one row with the path above the block
    lead = above.select("tree", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("node"),
                        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("given"), "subroot", "root", "above")
    null = lambda t: F.lit(None).cast(t)
    rows = nodes.select("tree", F.floor(F.col("pos") / size).alias("block"), "pos", "n", "node", "doc_id", "given",
                        null("string").alias("subroot"), null("string").alias("root"), null(PATH).alias("above"))
    together = rows.unionByName(lead).repartition(partitions(spark), "tree", "block").sortWithinPartitions("tree", "block", "pos")
    return together.mapInArrow(_finish, f"doc_id long, leaf string, given string, subroot string, root string, path {PATH}")


def proof(path: Column) -> Column:
    """Digest of a witness: all siblings, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(
        F.array_join(F.slice(s["others"], F.lit(1), s["slot"]), ""), h,
        F.array_join(F.slice(s["others"], s["slot"] + 1, F.size(s["others"])), "")), 256))


def report(docs: DataFrame) -> DataFrame:
    m = manifest(docs).select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("given"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 6, source_levels: int = 4) -> str:
    """The levels written out: up to 16**6 rows of a source, 16**4 sources."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = " || ".join(map(enc, COLUMNS[:-1]))
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    ctes = [f"""leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({row} || {enc("text")}) AS leaf,
    CASE WHEN {crc} % {TAMPER_STEP} = 0 THEN sha256({row} || {enc(f"translate(text, '{_UP}', '{_LOW}')")}) ELSE sha256({row} || {enc("text")}) END AS given
  FROM documents))""",
            "n0 AS MATERIALIZED (SELECT tree, p, leaf AS h FROM leaves)",
            "d0 AS MATERIALIZED (SELECT doc_id, leaf, tree, p, '' AS proof, given AS fold FROM leaves)"]

    def climb(i: int) -> list[str]:
        return [f"""r{i} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS many,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, p // {FAN} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, p // {FAN} ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM n{i})""",
                f"n{i + 1} AS MATERIALIZED (SELECT DISTINCT tree, p // {FAN} AS p, CASE WHEN many THEN sha256(pre || h || post) ELSE h END AS h FROM r{i})",
                f"""d{i + 1} AS MATERIALIZED (SELECT d.* REPLACE (d.p // {FAN} AS p, proof || pre || post AS proof,
  CASE WHEN many THEN sha256(pre || fold || post) ELSE fold END AS fold) FROM d{i} d JOIN r{i} r ON d.tree = r.tree AND d.p = r.p)"""]
    for i in range(levels):
        ctes += climb(i)
    k = levels + 1
    ctes += [f"n{k} AS MATERIALIZED (SELECT 0 AS tree, tree AS p, h FROM n{levels})",
             f"d{k} AS MATERIALIZED (SELECT d.* REPLACE (0 AS tree, d.tree AS p), h AS subroot FROM d{levels} d JOIN n{levels} n ON d.tree = n.tree)"]
    for i in range(k, k + source_levels):
        ctes += climb(i)
    end = k + source_levels
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified "
            f"FROM d{end} CROSS JOIN n{end}")


ORACLE = _oracle()
