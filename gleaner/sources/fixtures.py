"""Views that shape the landed tables into the pipeline's inputs.

The digest pipeline works on model-extracted news items; the landed data has
``documents``.  ``items`` maps each document to one item with integer and
string rules that mean the same in Spark SQL and in DuckDB, so every operator
can be checked against an independent engine.  Each rule exists once per
dialect: ``ITEMS_SPARK`` (Spark SQL expressions) and ``ITEMS_DUCK`` (a DuckDB
CTE used by the oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

# Word lists used with the fixture data (the documents hold no commerce
# words, so the operators are exercised with words that do occur).
FIXTURE_CORE_PATTERNS = ['tion on', 'that.*store', 'thand']
FIXTURE_SHOPPING_WORDS = ['the', 'que', 'sch']

_STATUS = "'CONFIRMED','REPORTED','RUMOR','OPINION','ANALYSIS'"

# --- Spark dialect ---------------------------------------------------------
_BASE_SPARK = [
    "doc_id AS item_id",
    "doc_id AS ord",
    "text",
    "source",
    "lang",
    "n_chars",
    # the first ten words only: the anchored match stops after them, so the
    # cost does not grow with the length of the document
    r"split(regexp_replace(regexp_extract(text, '^\\s*(\\S+(\\s+\\S+){0,9})', 1), '\\s+', ' '), ' ') AS words",
]

_ITEM_SPARK = [
    "item_id", "ord", "text", "source", "lang", "n_chars", "words",
    "array_join(slice(words, 1, 6), ' ') AS master_headline",
    "array_join(slice(words, 1, 10), ' ') AS headline",
    "text AS short_description",
    "CASE WHEN ord % 11 = 0 THEN 'N/A' "
    "ELSE concat('2024-01-', lpad(cast(ord % 28 + 1 AS string), 2, '0')) END AS date",
    "CASE WHEN ord % 4 = 0 THEN cast(array() AS array<string>) "
    "WHEN ord % 4 = 3 THEN array(concat('c', ord % 5), concat('c', ord % 3 + 5)) "
    "ELSE array(concat('c', ord % 5)) END AS companies",
    "CASE WHEN ord % 8 = 0 THEN cast(array() AS array<string>) "
    "ELSE array(concat('t', ord % 7), concat('t', ord % 2 + 7)) END AS technologies",
    f"element_at(array({_STATUS}), cast(ord % 5 + 1 AS int)) AS reality_status",
    f"concat('status ', element_at(array({_STATUS}), cast(ord % 5 + 1 AS int))) AS reality_reason",
    "CASE WHEN ord % 50 = 7 THEN NULL ELSE transform(sequence(1, 12), a -> named_struct("
    "'axiom_id', a, "
    "'judgment', CASE (ord * a + ord div 3) % 7 WHEN 0 THEN 'VIOLATION' WHEN 1 THEN 'TENSION' "
    "WHEN 2 THEN 'ALIGNED' WHEN 3 THEN 'ALIGNED' ELSE 'N/A' END, "
    "'reason', CASE WHEN (ord + a) % 3 = 0 THEN 'short' ELSE 'a long enough reason' END)) END AS axiom_check",
    "named_struct('count', cast(ord % 4 AS int), "
    "'top_violations', slice(array('v1', 'v2', 'v3'), 1, cast(ord % 4 AS int)), "
    "'minimal_repair', CASE WHEN ord % 4 = 0 THEN cast(array() AS array<string>) "
    "ELSE array(concat('repair ', ord % 3)) END) AS violations",
    "cast(ord % 4 AS int) AS violation_count",
    "CASE WHEN ord % 9 = 0 THEN 'GENERIC_ANGLE' ELSE substr(text, 20, cast(60 + ord % 160 AS int)) END AS linkedin_angle",
    "map_from_entries(filter(array("
    "named_struct('k', 'US', 'v', concat('us ', ord % 5)), "
    "named_struct('k', 'EU', 'v', concat('eu ', ord % 3)), "
    "named_struct('k', 'CN', 'v', CASE WHEN ord % 3 = 0 THEN NULL ELSE concat('cn ', ord % 4) END)), "
    "e -> e.k <> 'EU' OR ord % 2 = 0)) AS regional_implications",
    "cast(ord % 11 AS int) AS sovereignty_relevance_score",
    "CASE WHEN ord % 6 = 0 THEN cast(array() AS array<int>) ELSE array(cast(1 + ord % 14 AS int)) END AS aligned_theses",
]

# --- DuckDB dialect ----------------------------------------------------------
ITEMS_DUCK = f"""
items_base AS (
  SELECT doc_id AS item_id, doc_id AS ord, text, source, lang, n_chars,
         str_split(trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')), ' ') AS words
  FROM documents
),
items AS (
  SELECT item_id, ord, text, source, lang, n_chars, words,
    array_to_string(words[1:6], ' ') AS master_headline,
    array_to_string(words[1:10], ' ') AS headline,
    text AS short_description,
    CASE WHEN ord % 11 = 0 THEN 'N/A'
         ELSE '2024-01-' || lpad(CAST(ord % 28 + 1 AS VARCHAR), 2, '0') END AS date,
    CASE WHEN ord % 4 = 0 THEN CAST([] AS VARCHAR[])
         WHEN ord % 4 = 3 THEN ['c' || (ord % 5), 'c' || (ord % 3 + 5)]
         ELSE ['c' || (ord % 5)] END AS companies,
    CASE WHEN ord % 8 = 0 THEN CAST([] AS VARCHAR[])
         ELSE ['t' || (ord % 7), 't' || (ord % 2 + 7)] END AS technologies,
    [{_STATUS}][ord % 5 + 1] AS reality_status,
    'status ' || [{_STATUS}][ord % 5 + 1] AS reality_reason,
    CASE WHEN ord % 50 = 7 THEN NULL ELSE list_transform(range(1, 13), lambda a: {{
      'axiom_id': CAST(a AS INTEGER),
      'judgment': CASE (ord * a + ord // 3) % 7 WHEN 0 THEN 'VIOLATION' WHEN 1 THEN 'TENSION'
                  WHEN 2 THEN 'ALIGNED' WHEN 3 THEN 'ALIGNED' ELSE 'N/A' END,
      'reason': CASE WHEN (ord + a) % 3 = 0 THEN 'short' ELSE 'a long enough reason' END}}) END AS axiom_check,
    CAST(ord % 4 AS INTEGER) AS violation_count,
    ['v1', 'v2', 'v3'][1:CAST(ord % 4 AS INTEGER)] AS top_violations,
    CASE WHEN ord % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['repair ' || (ord % 3)] END AS minimal_repair,
    CASE WHEN ord % 9 = 0 THEN 'GENERIC_ANGLE' ELSE substr(text, 20, CAST(60 + ord % 160 AS INTEGER)) END AS linkedin_angle,
    'us ' || (ord % 5) AS region_us_raw,
    CASE WHEN ord % 2 = 0 THEN 'eu ' || (ord % 3) END AS region_eu_raw,
    CASE WHEN ord % 3 = 0 THEN NULL ELSE 'cn ' || (ord % 4) END AS region_cn_raw,
    CAST(ord % 11 AS INTEGER) AS sovereignty_relevance_score,
    CASE WHEN ord % 6 = 0 THEN CAST([] AS INTEGER[]) ELSE [CAST(1 + ord % 14 AS INTEGER)] END AS aligned_theses
  FROM items_base
)"""


def with_ctes(*ctes: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix from CTE bodies."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One news item per document (see module docstring)."""
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr(*_BASE_SPARK).selectExpr(*_ITEM_SPARK)


