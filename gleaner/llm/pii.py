"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

DataFrame functions only. The places of a pattern's matches come from the
pieces of text between them; whole texts are searched, and matches are found
leftmost first without overlap. Possessive repeats and look-behinds only keep
the search linear; they match what the plain patterns match.

Base kinds (kept whenever their check holds): email; ip (four numbers of at
most 255); card (14 to 19 digits, Luhn); phone (10 to 15 digits). Added by the
method: iban (country, check digits, mod-97) and ssn (three, two and four
digits, no checksum). Every span has a score: ``BASE_SCORE``, more if a checksum
confirmed it, more or less for words in the ``NEAR`` characters before it
(up to the match before). Added kinds count at ``THRESHOLD`` or more.

Edge cases: null counts as empty; empty texts have no spans; equal rows are
judged each; spans of different kinds may overlap; at one start the order is
email, ip, card, phone, iban, ssn. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> (quick test, pattern). \\G: where the match before ended.
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
CHECKED = ("ip", "card", "iban")
BASE_SCORE = {"email": 0.8, "ip": 0.4, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.3}
CHECKSUM_BONUS, CONTEXT_BONUS, CONTEXT_MALUS, THRESHOLD, NEAR = 0.4, 0.3, 0.3, 0.6, 40
WORDS_FOR = {"email": "mail|contact|write", "ip": "ip|server|host|address", "card": "card|visa|credit|payment",
             "phone": "phone|tel|call|mobile", "iban": "iban|account|bank", "ssn": "ssn|social security|tax"}
WORDS_AGAINST = "version|isbn|order no|sample|page"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ends(advance: Column, block: int = 512) -> Column:
    """Running sums of an array, in blocks, so that long arrays don't cost their square."""
    n = F.size(advance)
    part = lambda b: F.slice(advance, b * block + 1, F.lit(block))
    numbers = F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))
    grow = lambda s, x: F.struct((s["t"] + x).alias("t"), F.array_append(s["o"], s["t"] + x).alias("o"))
    empty = F.expr("cast(array() as array<int>)")
    total = F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0), lambda s, x: s + x))
    before = F.aggregate(total, F.struct(F.lit(0).alias("t"), empty.alias("o")), grow)["o"]
    return let(F.concat(F.array(F.lit(0)), before), lambda off: F.flatten(F.transform(numbers, lambda b: F.aggregate(
        part(b), F.struct(F.get(off, b).alias("t"), empty.alias("o")), grow)["o"])))


def luhn(digits: Column) -> Column:
    def one(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    c = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    def add(r, ch):
        v = F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
        return (r * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, ch: F.when(ch == "", r).otherwise(add(r, ch))) == 1


def _holds(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return v.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(v)
    return F.lit(True)


_SPAN = "array<struct<s:int,k:int,e:int,kind:string,score:double>>"


def spans_of(kind: str, text: Column) -> Column:
    """The kind's confirmed spans with their scores, in order."""
    quick, pattern = PATTERNS[kind]
    rank = (*BASE, *ADDED).index(kind)
    score = F.lit(BASE_SCORE[kind] + (CHECKSUM_BONUS if kind in CHECKED else 0))

    def placed(m):
        def build(pieces):
            def with_ends(ends):
                def span(i):
                    v = F.get(m, i)
                    near = F.lower(F.right(F.get(pieces, i), F.lit(NEAR)))
                    s = score + F.when(near.rlike(WORDS_FOR[kind]), CONTEXT_BONUS).otherwise(0) - F.when(near.rlike(WORDS_AGAINST), CONTEXT_MALUS).otherwise(0)
                    return F.struct((F.get(ends, i) - F.length(v)).alias("s"), F.lit(rank).alias("k"), F.get(ends, i).alias("e"), F.lit(kind).alias("kind"), s.cast("double").alias("score"))
                return F.transform(F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: _holds(kind, F.get(m, i))), span)
            return let(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(pieces, i))), lambda a: let(_ends(a), with_ends))
        return let(F.split(text, pattern, -1), build)
    none = F.expr(f"cast(array() as {_SPAN})")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m).cast(_SPAN)).otherwise(none))
    found = F.filter(found, lambda x: x["score"] >= THRESHOLD) if kind in ADDED else found
    worth = F.lit(True) if quick is None else F.contains(text, F.lit(quick))
    if kind != "email":
        worth = F.col("digits") & worth
    return F.when(worth, found).otherwise(none)


def find_pii(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, spans: array of s, k, e, kind, score by start) of every row; s and e count code points."""
    t = docs.select(id_column, F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("digits", F.col("text").rlike("[0-9]"))
    return t.select(id_column, F.array_sort(F.concat(*(spans_of(k, F.col("text")) for k in (*BASE, *ADDED)))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    base = lambda spans: F.filter(spans, lambda x: x["k"] < len(BASE))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))
    count = lambda i: F.size(F.filter("spans", lambda x: x["k"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
                        F.sha2(listed(base(F.col("spans"))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_kind(kind: str) -> str:
    """DuckDB's list of a kind's spans; the plain patterns, places from the pieces between matches."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
             "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": PATTERNS["phone"][1],
             "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"}[kind]
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    iban = "replace(v, ' ', '')"
    holds = {
        "ip": "len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3 OR try_cast(x AS HUGEINT) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, len({digits})), lambda i: CASE WHEN i % 2 = 0 "
                f"THEN CAST({digits}[len({digits}) - i] AS INT) ELSE (2 * CAST({digits}[len({digits}) - i] AS INT)) % 10 + "
                f"(2 * CAST({digits}[len({digits}) - i] AS INT)) // 10 END)) % 10 = 0",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split({iban}[5:] || {iban}[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
                "THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
    }.get(kind, "TRUE")
    score = BASE_SCORE[kind] + (CHECKSUM_BONUS if kind in CHECKED else 0)
    near = f"lower(right(p, {NEAR}))"
    keep = "TRUE" if kind in BASE else (f"{score} + CASE WHEN regexp_matches({near}, '{WORDS_FOR[kind]}') THEN {CONTEXT_BONUS} ELSE 0 END"
                                        f" - CASE WHEN regexp_matches({near}, '{WORDS_AGAINST}') THEN {CONTEXT_MALUS} ELSE 0 END >= {THRESHOLD}")
    rank = (*BASE, *ADDED).index(kind)
    return f"""
SELECT doc_id, '{kind}' AS kind, {rank} AS k, e - len(v) AS s, e FROM (
  SELECT doc_id, m[i] AS v, p[i] AS p, sum(len(p[i]) + len(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{plain}') AS m, string_split_regex(coalesce(text, ''), '{plain}') AS p FROM documents)))
WHERE {holds} AND {keep}"""


_NAME = "kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR)"
ORACLE = f"""
WITH x AS ({' UNION ALL '.join(_sql_kind(k) for k in (*BASE, *ADDED))}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg({_NAME}, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg({_NAME}, ',' ORDER BY s, k) AS spans FROM x GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""
