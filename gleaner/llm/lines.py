"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier line has the same words (A-Z lower-cased, split at
ASCII space) or, both having ``NEAR_WORDS`` words or more, differs from it by
one word inserted, deleted or replaced. Earlier means a smaller doc_id (of rows
with equal doc_id the first stored; null last), in one document the line above. Lines are
judged on the input, not on what is left. Lines without words stay.

* Equal lines meet by a 128-bit digest; only their first goes on.
* Two lines one edit apart share their first or their last half, in the words
  of the shorter. Lines without a repeated half have no near line and emit
  nothing further.
* The others emit every variant with one word deleted, as hashed keys with the
  place of the deletion, and themselves whole. Equal variants with equal place
  are a replaced word apart; a variant equal to a whole line is one word
  longer. Each key group is reduced to its earliest line before it is joined
  back, so a group of any size yields no pairs but a match for each member.
* The edit distance of each match is verified on the words.

Edge cases: null and empty texts have no lines to remove and stay as they are;
very long lines and texts are whole; an empty table gives an empty result.
Other columns pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_positions, keyed_table, materialize, partitions, plain, prepare, restored, texts_of

NEAR_WORDS = 5  # one word of five: a similarity of 0.8
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_bits(n_rows: int) -> int:
    """Bits of a line's number in ``ord`` = row << bits | line: 31, enough for any text, up to 2^32 rows."""
    return min(31, 63 - max(n_rows - 1, 0).bit_length())


def half_keys(w: list[bytes]) -> list[int]:
    """Keys of the halves that a line one edit apart shares with these words."""
    n = len(w)
    out = set()
    for h in {n // 2, (n - 1) // 2}:
        out.add(_long(xxhash.xxh64_intdigest(b" ".join(w[:h]), h * 2)))
        out.add(_long(xxhash.xxh64_intdigest(b" ".join(w[n - h:]), h * 2 + 1)))
    return list(out)


def _line_rows(docs: DataFrame, bits: int) -> DataFrame:
    """(pos, text) -> a row for each line with words: ord, n, digest h1 h2, half keys."""
    def run(batches):
        for b in batches:
            cols = [[] for _ in range(5)]
            for pos, t in zip(b.column("pos").to_pylist(), texts_of(b)):
                for ln, line in enumerate(t.lower().split(b"\n")):
                    w = line.split()
                    if not w:
                        continue
                    if ln >> bits:
                        raise ValueError(f"line {ln} of a text: too many lines for a table of so many rows")
                    d = xxhash.xxh3_128_intdigest(b" ".join(w))
                    for c, v in zip(cols, (pos << bits | ln, len(w), _long(d >> 64), _long(d & (1 << 64) - 1),
                                           half_keys(w) if len(w) >= NEAR_WORDS else [])):
                        c.append(v)
                if len(cols[0]) > 1 << 16:
                    yield _lines_batch(cols)
                    cols = [[] for _ in range(5)]
            yield _lines_batch(cols)
    return docs.select("pos", "text").mapInArrow(run, "ord long, n int, h1 long, h2 long, halves array<long>")


def _lines_batch(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["ord", "n", "h1", "h2", "halves"])


def variants(w: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys: of the words with each one deleted, and last of all words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n, out = len(w), []
    for base, salt in ((_B1, np.uint64(0)), (_B2, np.uint64(0x5851F42D4C957F2D))):
        x = h ^ salt
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base))))
        before = np.concatenate(([np.uint64(0)], np.cumsum(x * power[:n])))
        after = np.concatenate(([np.uint64(0)], np.cumsum(x[1:] * power[:n - 1])))  # each word one place to the left
        v = np.append(before[:n] + after[-1] - after, before[n])
        out.append((v ^ (v >> np.uint64(29))).view(np.int64))
    return out[0], out[1]


def _variant_rows(lines: DataFrame) -> DataFrame:
    """(ord, line) -> (v1, v2, i, ord); i is the deleted word's place, -1 for the whole line."""
    def run(batches):
        for b in batches:
            parts, size = [], 0
            for o, t in zip(b.column("ord").to_pylist(), texts_of(b, "line")):
                v1, v2 = variants(t.lower().split())
                i = np.arange(len(v1), dtype=np.int32)
                i[-1] = -1
                parts.append((v1, v2, i, np.full(len(v1), o)))
                size += len(v1)
                if size > 1 << 17:
                    yield pa.RecordBatch.from_pydict(dict(zip(("v1", "v2", "i", "ord"), map(np.concatenate, zip(*parts)))))
                    parts, size = [], 0
            if parts:
                yield pa.RecordBatch.from_pydict(dict(zip(("v1", "v2", "i", "ord"), map(np.concatenate, zip(*parts)))))
    return lines.mapInArrow(run, "v1 long, v2 long, i int, ord long")


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Word edit distance of at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ok = [within_one(x.lower().split(), y.lower().split()) for x, y in zip(texts_of(b, "line"), texts_of(b, "other"))]
            yield pa.RecordBatch.from_arrays([b.column("ord").filter(pa.array(ok, pa.bool_()))], ["ord"])
    return pairs.select("ord", "line", "other").mapInArrow(run, "ord long")


def _pick_lines(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(pos, lns) of wanted lines -> (ord, line text)."""
    def run(batches):
        for b in batches:
            o, ls = [], []
            for pos, t, lns in zip(b.column("pos").to_pylist(), texts_of(b), b.column("lns").to_pylist()):
                split = t.split(b"\n")
                o += [pos << bits | k for k in lns]
                ls += [split[k] for k in lns]
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(ls, pa.binary()).cast(pa.string())], ["ord", "line"])
    return rows.join(wanted.hint("shuffle_hash"), "rid").select("pos", "text", "lns").mapInArrow(run, "ord long, line string")


def _by_row(lines: DataFrame, places: DataFrame, bits: int) -> DataFrame:
    """(ord) -> (rid, pos, lns): the line numbers of each row."""
    return (lines.select(F.shiftright("ord", bits).alias("pos"), F.col("ord").bitwiseAND((1 << bits) - 1).cast("int").alias("ln"))
            .groupBy("pos").agg(F.collect_list("ln").alias("lns")).join(places, "pos"))


def repeated_lines(rows: DataFrame, places: DataFrame, bits: int) -> DataFrame:
    """(ord) of the lines to remove. ``places``: rid and pos of the rows; ``bits``: of a line's number in ord."""
    spark = rows.sparkSession
    lines = materialize(_line_rows(rows.join(places.hint("shuffle_hash"), "rid"), bits), "lines")
    firsts = lines.groupBy("h1", "h2").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies"))
    copies = (lines.select("h1", "h2", "ord").join(firsts.filter("copies > 1").withColumnRenamed("ord", "first"), ["h1", "h2"])
              .filter("ord > first").select("ord"))
    copies = materialize(copies, "line_copies")
    # of equal lines the first stands for all
    keys = (lines.filter(f"n >= {NEAR_WORDS}").select("h1", "h2", "ord", "halves")
            .join(copies, "ord", "left_anti").select("ord", F.explode("halves").alias("half")))
    shared = keys.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    near = keys.join(shared, "half").select("ord").distinct()
    texts = materialize(_pick_lines(rows, _by_row(near, places, bits), bits), "near_lines")
    v = _variant_rows(texts.repartition(partitions(spark))).repartition(partitions(spark), "v1", "v2")
    same = v.groupBy("v1", "v2", "i").agg(F.min("ord").alias("m"))
    group = (same.groupBy("v1", "v2").agg(
        F.min(F.when(F.col("i") < 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("m"))).alias("cut")))
    # a variant's match: the earliest line with the same variant, or the whole line that it equals
    found = (v.join(same, ["v1", "v2", "i"]).join(group, ["v1", "v2"])
             .select("ord", F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least("m", "whole")).alias("match"))
             .filter("match < ord").groupBy("ord").agg(F.min("match").alias("match")))
    other = texts.select(F.col("ord").alias("match"), F.col("line").alias("other"))
    edited = _verified(found.join(texts, "ord").join(other, "match"))
    return copies.unionByName(edited).distinct()


def _without(batches):
    """Takes the lines numbered in ``_lns`` out of ``text``."""
    for b in batches:
        texts = []
        for t, lns in zip(texts_of(b), b.column("_lns").to_pylist()):
            gone = set(lns)
            texts.append(b"\n".join(x for k, x in enumerate(t.split(b"\n")) if k not in gone))
        i = b.schema.get_field_index("text")
        text = pa.array(texts, pa.binary()).cast(b.schema.field("text").type)
        yield b.set_column(i, "text", text).drop_columns(["_lns"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus n_lines and n_removed (long).

    Every row stays, one that has lost all its lines with an empty text.
    """
    prepare(docs.sparkSession)
    rows = keyed_table(plain(docs), "lines_docs")
    places = materialize(dense_positions(rows.select("rid", "doc_id"), "order", F.col("doc_id").asc_nulls_last(), "rid").select("rid", "pos"), "places")
    bits = line_bits(places.count())
    gone = _by_row(repeated_lines(rows, places, bits), places, bits).select("rid", F.col("lns").alias("_lns"))
    n = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    both = rows.join(gone.hint("shuffle_hash"), "rid", "left").withColumns(
        {"n_lines": n, "n_removed": F.coalesce(F.size("_lns"), F.lit(0)).cast("long")}).drop("rid")
    whole = both.filter("_lns is null").drop("_lns")
    done = whole.unionByName(both.filter("_lns is not null").mapInArrow(_without, whole.schema))
    return restored(done, docs, "n_lines", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH l AS MATERIALIZED (
  SELECT doc_id, ln, line, regexp_extract_all(translate(line, '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents)),
f AS MATERIALIZED (SELECT *, array_to_string(ws, ' ') AS k, row_number() OVER (ORDER BY doc_id, ln) AS o FROM l),
g AS MATERIALIZED (SELECT *, min(o) OVER (PARTITION BY k) AS first FROM f WHERE len(ws) > 0),
u AS MATERIALIZED (SELECT o, ws, k FROM g WHERE o = first AND len(ws) >= {NEAR_WORDS}),
v AS MATERIALIZED (SELECT o, i, hash(array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ')) AS h
  FROM (SELECT o, ws, unnest(range(1, len(ws) + 1)) AS i FROM u)),
w AS (SELECT o, hash(k) AS h FROM u),
near AS (
  SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY h, i) AS m FROM v) WHERE m < o
  UNION SELECT v.o FROM v JOIN w USING (h) WHERE w.o < v.o
  UNION SELECT w.o FROM v JOIN w USING (h) WHERE v.o < w.o),
r AS (SELECT f.*, coalesce(g.first < f.o, FALSE) OR f.o IN (SELECT o FROM near) AS gone FROM f LEFT JOIN g USING (o))
SELECT doc_id, CASE WHEN max(length(line)) = 0 AND count(*) = 1 THEN 0 ELSE count(*) END AS n_lines,
  CAST(sum(gone::INT) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
