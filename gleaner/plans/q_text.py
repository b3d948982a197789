"""Queries for mail extraction, text cleaning, chunking and model-response parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import jsonfix as J
from ..functions.html import ENTITIES, html_to_text
from ..functions.text import collapse_space
from ..operators import gates
from ..operators import text_ops as T
from ..sources import text_views as TV
from ..sources.fixtures import ITEMS_DUCK, items, with_ctes
from ..sources.tables import table
from . import duck as D
from .registry import register

WS = "[ \\t\\n\\r\\f\\x0B]"          # ASCII whitespace, same class in both engines


def _trim_d(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# ----------------------------------------------------------------------------
# mail
# ----------------------------------------------------------------------------
@register("s01_scan_recent", with_ctes(TV.NEWSLETTERS_DUCK) +
          "SELECT id FROM newsletters WHERE label = 'newsletters' AND received_day >= DATE '2024-01-20' - INTERVAL 7 DAY")
def s01_scan_recent(spark, sf):
    return T.scan_recent(TV.newsletters(spark, sf), "newsletters", "2024-01-20", 7).select("id")


@register("s02_extract_html_body", with_ctes(TV.NEWSLETTERS_DUCK) + """
SELECT id, CASE WHEN id % 5 = 0 THEN 'No Subject' ELSE subject END AS subject, sender,
       md5(body_html) AS body_md5, length(body_html) AS body_len
FROM newsletters WHERE id % 4 <> 3 AND body_html <> ''""")
def s02_extract_html_body(spark, sf):
    m = T.mail_rows(TV.mime(spark, sf))
    return m.select("id", "subject", "sender", F.md5("body_html").alias("body_md5"),
                    F.length("body_html").cast("long").alias("body_len"))


@register("s03_header_value", with_ctes(TV.NEWSLETTERS_DUCK) +
          "SELECT id, CASE WHEN id % 5 = 0 THEN 'No Subject' ELSE subject END AS subject, sender FROM newsletters")
def s03_header_value(spark, sf):
    p = F.col("payload")
    return TV.mime(spark, sf).select("id", T.header_value(p["headers"], "Subject", "No Subject").alias("subject"),
                                     T.header_value(p["headers"], "From", "No Sender").alias("sender"))


def _html_duck(x: str) -> str:
    x = (f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', chr(10), 'g')")
    x = f"regexp_replace({x}, '<[a-zA-Z/!?][^>]*>', chr(10), 'g')"
    for name, ch in ENTITIES:
        x = f"replace({x}, {D.q(name)}, {D.q(ch)})"
    x = f"replace({x}, '&amp;', '&')"
    return (f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda s: {_trim_d('s')}), "
            f"lambda s: s <> ''), chr(10))")


@register("t01_html_to_text", f"SELECT page_id, md5(t) AS text_md5, length(t) AS text_len FROM "
          f"(SELECT page_id, {_html_duck('html')} AS t FROM pages)")
def t01_html_to_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", html_to_text("html").alias("t"))
    return p.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("text_len"))


def _clean_duck(x: str) -> str:
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    for r in P.BOILERPLATE_RULES:
        x = f"regexp_replace({x}, {D.q('(?i)' + r)}, '', 'g')"
    return _trim_d(x)


@register("t02_normalise_space", with_ctes(TV.FOOTER_DUCK) + """
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS text_md5
FROM footer_text""")
def t02_normalise_space(spark, sf):
    return TV.footer_text(spark, sf).select("doc_id", F.md5(collapse_space("text")).alias("text_md5"))


@register("t03_strip_boilerplate", with_ctes(TV.FOOTER_DUCK) +
          f"SELECT doc_id, md5(t) AS text_md5, length(t) AS text_len FROM (SELECT doc_id, {_clean_duck('text')} AS t FROM footer_text)")
def t03_strip_boilerplate(spark, sf):
    t = TV.footer_text(spark, sf).select("doc_id", T.clean_text("text").alias("t"))
    return t.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("text_len"))


@register("t04_estimate_tokens", "SELECT doc_id, CAST(length(text) AS DOUBLE) / 4 AS tokens FROM documents")
def t04_estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@register("t05_needs_chunking", "SELECT doc_id, CAST(length(text) AS DOUBLE) / 4 > 1800.0 AS needs_chunking FROM documents")
def t05_needs_chunking(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.needs_chunking(T.estimate_tokens("text"), 2000, 0.9).alias("needs_chunking"))


_CHUNKS_DUCK = """
chunks AS (
  SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, substr(text, s, 500) AS chunk FROM (
    SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 450)) AS s,
           unnest(range(1, len(range(1, greatest(length(text), 1) + 1, 450)) + 1)) AS pos FROM documents)
)"""


@register("t06_chunk_text", with_ctes(_CHUNKS_DUCK) + "SELECT doc_id, pos, length(chunk) AS chunk_len, md5(chunk) AS chunk_md5 FROM chunks")
def t06_chunk_text(spark, sf):
    c = T.chunk_text(table(spark, sf, "documents"), "text", "doc_id", 500, 50)
    return c.select("doc_id", "pos", F.length("chunk").cast("long").alias("chunk_len"), F.md5("chunk").alias("chunk_md5"))


@register("t08_combine_chunks", with_ctes(_CHUNKS_DUCK) + """
SELECT doc_id, md5(string_agg(chunk, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) AS combined_md5
FROM chunks GROUP BY 1""")
def t08_combine_chunks(spark, sf):
    c = T.chunk_text(table(spark, sf, "documents"), "text", "doc_id", 500, 50)
    return T.combine_chunks(c, "doc_id").select("doc_id", F.md5("combined").alias("combined_md5"))


# ----------------------------------------------------------------------------
# responses
# ----------------------------------------------------------------------------
_FENCE_DUCK = f"""
fenced AS (SELECT doc_id, response, {_trim_d('response')} AS t0 FROM responses),
stripped AS (
  SELECT doc_id, response, CASE WHEN starts_with(t0, '```') THEN {_trim_d(
    "array_to_string(CASE WHEN len(string_split(t0, chr(10))) <= 1 THEN [] "
    "WHEN trim(string_split(t0, chr(10))[-1]) = '```' THEN string_split(t0, chr(10))[2:len(string_split(t0, chr(10))) - 1] "
    "ELSE string_split(t0, chr(10))[2:] END, chr(10))")} ELSE t0 END AS t
  FROM fenced
)"""

RESP = with_ctes(ITEMS_DUCK, TV.RESPONSES_DUCK, _FENCE_DUCK)


@register("t09_strip_code_fence", RESP + "SELECT doc_id, md5(t) AS text_md5 FROM stripped")
def t09_strip_code_fence(spark, sf):
    return TV.responses_table(spark, sf).select("doc_id", F.md5(J.strip_code_fence("response")).alias("text_md5"))


@register("t10_sanitize_json_strings", RESP + "SELECT doc_id, md5(replace(t, chr(10), '\\n')) AS text_md5 FROM stripped")
def t10_sanitize_json_strings(spark, sf):
    r = TV.responses_table(spark, sf)
    return r.select("doc_id", F.md5(J.sanitize_json_strings(J.strip_code_fence("response"))).alias("text_md5"))


def _valid_d(x: str) -> str:
    # DuckDB accepts trailing commas; the Python parser does not
    return f"(json_valid({x}) AND NOT regexp_matches({x}, ',{WS}*[}}\\]]'))"


@register("t11_repair_parse_json", RESP + f"""
, cand AS (
  SELECT doc_id, t, replace(t, chr(10), '\\n') AS san,
         nullif(regexp_extract(t, '(?s)\\[.*\\]', 0), '') AS arr, nullif(regexp_extract(t, '(?s)\\{{.*\\}}', 0), '') AS obj
  FROM stripped
),
chosen AS (
  SELECT doc_id, CASE WHEN {_valid_d('t')} THEN t WHEN {_valid_d('san')} THEN san
    WHEN arr IS NOT NULL AND {_valid_d('arr')} THEN arr WHEN arr IS NOT NULL AND {_valid_d("replace(arr, chr(10), '\\n')")} THEN replace(arr, chr(10), '\\n')
    WHEN obj IS NOT NULL AND {_valid_d('obj')} THEN obj WHEN obj IS NOT NULL AND {_valid_d("replace(obj, chr(10), '\\n')")} THEN replace(obj, chr(10), '\\n')
    WHEN {_valid_d(f"regexp_replace(san, ',{WS}*([}}\\]])', '\\1', 'g')")} THEN regexp_replace(san, ',{WS}*([}}\\]])', '\\1', 'g') END AS c
  FROM cand
),
listed AS (SELECT doc_id, CASE WHEN json_type(CAST(c AS JSON)) = 'OBJECT' THEN '[' || c || ']' ELSE c END AS j FROM chosen)
SELECT doc_id, j IS NOT NULL AS ok, CAST(json_array_length(CAST(j AS JSON)) AS BIGINT) AS n_items,
       json_extract_string(CAST(j AS JSON), '$[0].headline') AS first_headline FROM listed""".replace("\n, cand AS", ",\ncand AS", 1))
def t11_repair_parse_json(spark, sf):
    r = TV.responses_table(spark, sf).select("doc_id", J.repair_parse_json("response").alias("j"))
    return r.select("doc_id", F.col("j").isNotNull().alias("ok"),
                    F.json_array_length("j").cast("long").alias("n_items"),
                    F.get_json_object("j", "$[0].headline").alias("first_headline"))


_EXTRACT_DUCK = f"""
extracted AS (
  SELECT doc_id, CASE
    WHEN regexp_extract(response, '(?s)(\\{{.*\\}})', 1) <> '' THEN '[' || {_trim_d("regexp_extract(response, '(?s)(\\{.*\\})', 1)")} || ']'
    WHEN starts_with({_trim_d('response')}, '[') AND ends_with({_trim_d('response')}, ']') THEN {_trim_d('response')}
    WHEN regexp_extract(response, '(?s)\\[.*\\]', 0) <> '' THEN {_trim_d("regexp_extract(response, '(?s)\\[.*\\]', 0)")}
    ELSE {_trim_d('response')} END AS js
  FROM responses
),
parsed AS (SELECT doc_id, js, json_valid(js) AS ok FROM extracted),
elems AS (
  SELECT doc_id, CAST(generate_subscripts(CAST(js AS JSON[]), 1) - 1 AS INTEGER) AS pos, unnest(CAST(js AS JSON[])) AS e
  FROM parsed WHERE ok
),
checked AS (
  SELECT doc_id, pos, e, list_filter({J.REQUIRED_KEYS_FULL!r}, lambda k: NOT list_contains(json_keys(e), k)) AS missing
  FROM elems
)"""

EXTR = with_ctes(ITEMS_DUCK, TV.RESPONSES_DUCK, _EXTRACT_DUCK)


def _parsed(spark, sf):
    return J.parse_items(TV.responses_table(spark, sf), "response", "doc_id")


def _exploded(spark, sf):
    return J.explode_items(_parsed(spark, sf), "doc_id")


@register("t12_extract_item_json", EXTR + "SELECT doc_id, md5(js) AS json_md5 FROM extracted")
def t12_extract_item_json(spark, sf):
    return TV.responses_table(spark, sf).select("doc_id", F.md5(J.extract_item_json("response")).alias("json_md5"))


@register("t13_explode_items", EXTR + """
SELECT doc_id, pos, len(missing) = 0 AS valid, json_extract_string(e, '$.headline') AS headline FROM checked""")
def t13_explode_items(spark, sf):
    e = _exploded(spark, sf)
    return e.select("doc_id", "pos", "valid", F.try_element_at("m", F.lit("headline")).alias("headline"))


@register("t14_missing_keys", EXTR + "SELECT doc_id, pos, array_to_string(missing, ',') AS missing FROM checked WHERE len(missing) > 0")
def t14_missing_keys(spark, sf):
    e = _exploded(spark, sf).filter(~F.col("valid"))
    return e.select("doc_id", "pos", F.array_join("missing_keys", ",").alias("missing"))


@register("t15_flatten_violations", EXTR + """
SELECT doc_id, coalesce(CAST(json_extract(e, '$.violations.count') AS INTEGER), 0) AS violation_count,
  array_to_string(coalesce(CAST(json_extract(e, '$.violations.top_violations') AS VARCHAR[]), []), '; ') AS top_violations_formatted,
  array_to_string(coalesce(CAST(json_extract(e, '$.violations.minimal_repair') AS VARCHAR[]), []), '; ') AS minimal_repairs_formatted
FROM checked WHERE len(missing) = 0""")
def t15_flatten_violations(spark, sf):
    e = _exploded(spark, sf).filter("valid")
    v = F.from_json(F.try_element_at("m", F.lit("violations")),
                    "struct<count:int,top_violations:array<string>,minimal_repair:array<string>>")
    return e.select("doc_id", *T.flatten_violations(v))


@register("t16_flatten_regions", EXTR + """
SELECT doc_id, coalesce(nullif(json_extract_string(e, '$.regional_implications.US'), ''), '') AS region_us,
  coalesce(nullif(json_extract_string(e, '$.regional_implications.EU'), ''), '') AS region_eu,
  coalesce(nullif(json_extract_string(e, '$.regional_implications.CN'), ''), '') AS region_cn,
  coalesce(nullif(json_extract_string(e, '$.regional_implications.ASIA'), ''), '') AS region_asia
FROM checked WHERE len(missing) = 0""")
def t16_flatten_regions(spark, sf):
    e = _exploded(spark, sf).filter("valid")
    m = F.from_json(F.try_element_at("m", F.lit("regional_implications")), "map<string,string>")
    return e.select("doc_id", *T.flatten_regions(m))


@register("t33_newsletter_brief", EXTR + f"""
, per AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE len(missing) = 0) AS v,
                 arg_min(coalesce(json_extract_string(e, '$.short_description'), 'N/A'), pos) FILTER (WHERE len(missing) = 0) AS d
          FROM checked GROUP BY 1)
SELECT p.doc_id, CASE WHEN coalesce(v, 0) > 0 THEN 90 ELSE 0 END AS relevance_score,
  CASE WHEN NOT p.ok THEN {D.q(J.MSG_PARSE_FAILED)} WHEN coalesce(v, 0) > 0 THEN d
       WHEN coalesce(n, 0) = 0 THEN {D.q(J.MSG_NO_CONTENT)} ELSE {D.q(J.MSG_NO_WELL_FORMED)} END AS brief
FROM parsed p LEFT JOIN per USING (doc_id)""".replace("\n, per AS", ",\nper AS", 1))
def t33_newsletter_brief(spark, sf):
    p = _parsed(spark, sf)
    return T.newsletter_brief(p, J.explode_items(p, "doc_id"), "doc_id").select(
        "doc_id", F.col("relevance_score").cast("int").alias("relevance_score"), "brief")


@register("g05_relevance_floor", EXTR + """
SELECT DISTINCT doc_id FROM checked WHERE len(missing) = 0""")
def g05_relevance_floor(spark, sf):
    p = _parsed(spark, sf)
    b = T.newsletter_brief(p, J.explode_items(p, "doc_id"), "doc_id")
    return T.relevance_floor(b, 50).select("doc_id")


@register("ua_concat_items", EXTR + """
SELECT doc_id, pos, json_extract_string(e, '$.headline') AS headline,
       CASE WHEN doc_id % 2 = 0 THEN 'even' END AS batch_tag FROM checked WHERE len(missing) = 0""")
def ua_concat_items(spark, sf):
    """U-A: items of separately processed batches concatenated by name (columns may differ)."""
    e = _exploded(spark, sf).filter("valid").select("doc_id", "pos", F.try_element_at("m", F.lit("headline")).alias("headline"))
    even = e.filter(F.col("doc_id") % 2 == 0).withColumn("batch_tag", F.lit("even"))
    odd = e.filter(F.col("doc_id") % 2 == 1)
    return even.unionByName(odd, allowMissingColumns=True)


# ----------------------------------------------------------------------------
# item fields
# ----------------------------------------------------------------------------
_SENDER_S = ("CASE WHEN ord % 3 = 0 THEN concat('Sender ', source, ' <', source, '@example.com>') "
             "WHEN ord % 3 = 1 THEN concat('Plain ', source) END")
_OWN_SRC_S = "CASE WHEN ord % 7 = 0 THEN 'N/A' WHEN ord % 7 = 1 THEN '' WHEN ord % 7 = 2 THEN NULL ELSE source END"


@register("t17_resolve_source", with_ctes(ITEMS_DUCK) + f"""
SELECT item_id, CASE WHEN coalesce(own, '') NOT IN ('', 'N/A') THEN own
  WHEN contains(coalesce(sender, ''), '<') THEN {_trim_d("split_part(sender, '<', 1)")}
  WHEN coalesce(sender, '') <> '' THEN sender ELSE 'N/A' END AS source
FROM (SELECT item_id, {_OWN_SRC_S} AS own, {_SENDER_S.replace("concat('Sender ', source, ' <', source, '@example.com>')", "'Sender ' || source || ' <' || source || '@example.com>'").replace("concat('Plain ', source)", "'Plain ' || source")} AS sender FROM items)""")
def t17_resolve_source(spark, sf):
    it = items(spark, sf)
    return it.select("item_id", T.resolve_source(F.expr(_OWN_SRC_S), F.expr(_SENDER_S)).alias("source"))


@register("t18_resolve_date", with_ctes(ITEMS_DUCK) + """
SELECT item_id, CASE WHEN coalesce(d, '') IN ('', 'N/A') THEN '2024-02-01' ELSE d END AS date
FROM (SELECT item_id, CASE WHEN ord % 13 = 0 THEN '' ELSE date END AS d FROM items)""")
def t18_resolve_date(spark, sf):
    it = items(spark, sf)
    d = F.when(F.col("ord") % 13 == 0, F.lit("")).otherwise(F.col("date"))
    return it.select("item_id", T.resolve_date(d, F.lit("2024-02-01")).alias("date"))


@register("t21_select_text", with_ctes(ITEMS_DUCK) + f"""
SELECT item_id, CASE WHEN {_trim_d('f')} <> '' THEN {_trim_d('f')}
  WHEN {_trim_d("headline || ' ' || master_headline")} <> '' THEN {_trim_d("headline || ' ' || master_headline")}
  ELSE 'No content available' END AS text
FROM (SELECT *, CASE WHEN ord % 10 = 0 THEN '   ' ELSE short_description END AS f FROM items)""")
def t21_select_text(spark, sf):
    it = items(spark, sf)
    f = F.when(F.col("ord") % 10 == 0, F.lit("   ")).otherwise(F.col("short_description"))
    return it.select("item_id", T.select_text(f, F.col("headline"), F.col("master_headline")).alias("text"))


@register("t22_to_list", with_ctes(ITEMS_DUCK) + """
SELECT item_id, array_to_string(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS topics
FROM (SELECT item_id, array_to_string(companies, ' , ') || ',, ' || array_to_string(technologies, ',') AS s FROM items)""")
def t22_to_list(spark, sf):
    it = items(spark, sf)
    s = F.concat(F.array_join("companies", " , "), F.lit(",, "), F.array_join("technologies", ","))
    return it.select("item_id", F.array_join(T.to_list(s), "|").alias("topics"))


@register("t27_content_key", f"SELECT doc_id, sha256('{TV.STORE_MODEL}' || ':' || text) AS key FROM documents")
def t27_content_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_key(TV.STORE_MODEL, F.col("text")).alias("key"))


@register("t28_prompt_list", """
SELECT string_agg(CAST(id AS VARCHAR) || '. ' || txt, chr(10) ORDER BY id) AS prompt_list FROM (
  SELECT CAST(substr(source, 4) AS INTEGER) AS id, source || ': ' || CAST(count(*) AS VARCHAR) || ' documents' AS txt
  FROM documents GROUP BY source)""")
def t28_prompt_list(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    dim = d.select(F.substring("source", 4, 10).cast("int").alias("id"),
                   F.concat("source", F.lit(": "), F.col("n").cast("string"), F.lit(" documents")).alias("text"))
    return T.prompt_list(dim, "id", "text")


@register("t29_compact_payload", with_ctes(ITEMS_DUCK, """
tiered AS (SELECT *, CASE WHEN contains(lower(concat_ws(' ', headline, short_description)), 'tion on') THEN 'CORE'
                          ELSE 'ADJACENT' END AS relevance_tier,
                  (row_number() OVER (ORDER BY ord) - 1) // 5 AS batch FROM items)""") + """
SELECT batch, CAST(to_json(list({'headline': headline, 'short_description': substr(coalesce(short_description, ''), 1, 250),
  'relevance_tier': relevance_tier, 'violation_count': violation_count, 'reality_status': reality_status,
  'companies': companies, 'linkedin_angle': substr(coalesce(linkedin_angle, ''), 1, 200)} ORDER BY ord)) AS VARCHAR) AS payload
FROM tiered GROUP BY batch""")
def t29_compact_payload(spark, sf):
    from .q_cluster import batch_index
    it = gates.classify_tier(items(spark, sf), ["tion on"])
    b = batch_index(it, 5)
    from ..functions.text import truncate
    fields = {"headline": F.col("headline"), "short_description": truncate("short_description", 250),
              "relevance_tier": F.col("relevance_tier"), "violation_count": F.col("violation_count"),
              "reality_status": F.col("reality_status"), "companies": F.col("companies"),
              "linkedin_angle": truncate("linkedin_angle", 200)}
    return T.compact_payload(b, "batch", "ord", fields)


@register("t31_format_theses", with_ctes(ITEMS_DUCK) + """
SELECT item_id, array_to_string(list_transform(aligned_theses, lambda x: CAST(x AS VARCHAR)), ', ') AS theses_formatted,
  array_to_string(list_transform(aligned_theses, lambda x: CAST(x AS VARCHAR) || ':' || CAST(sovereignty_relevance_score AS VARCHAR)), ', ') AS scores_formatted
FROM items""")
def t31_format_theses(spark, sf):
    it = items(spark, sf)
    scores = F.map_from_arrays(F.transform("aligned_theses", lambda x: x.cast("string")),
                               F.transform("aligned_theses", lambda x: F.col("sovereignty_relevance_score")))
    return it.select("item_id", *T.format_theses(F.col("aligned_theses"), scores))


_PAGE = 50_000


@register("t30_cluster_text", with_ctes(ITEMS_DUCK) + f""",
l AS (SELECT e.label AS cluster_id, i.ord, '- ' || coalesce(i.headline, '') || ': ' || coalesce(i.short_description, '') AS line
      FROM embeddings e JOIN items i ON i.item_id = e.vec_id),
p AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY cluster_id ORDER BY ord) - length(line) - 1 AS BIGINT) // {_PAGE} AS page FROM l)
SELECT cluster_id, page, md5(string_agg(line, chr(10) ORDER BY ord)) AS text_md5 FROM p GROUP BY ALL""")
def t30_cluster_text(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("cluster_id"))
    j = items(spark, sf).join(e, "item_id")
    return T.cluster_text(j, page_chars=_PAGE).select("cluster_id", "page", F.md5("cluster_text").alias("text_md5"))


@register("t34_run_status", with_ctes(ITEMS_DUCK) + """
SELECT 'Processed ' || CAST((SELECT count(*) FROM pages) AS VARCHAR) || ' newsletters, '
  || CAST((SELECT count(*) FROM items WHERE violation_count > 0) AS VARCHAR) || ' items kept of '
  || CAST((SELECT count(*) FROM items) AS VARCHAR) || '; '
  || CAST((SELECT count(DISTINCT label) FROM embeddings) AS VARCHAR) || ' clusters, '
  || CAST((SELECT count(*) FROM embeddings WHERE vec_id % 13 = 0) AS VARCHAR) || ' noise items' AS status""")
def t34_run_status(spark, sf):
    pages = table(spark, sf, "pages").agg(F.count(F.lit(1)).alias("newsletters"))
    it = items(spark, sf).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("violation_count") > 0).alias("kept"))
    e = table(spark, sf, "embeddings").agg(F.countDistinct("label").alias("clusters"),
                                           F.count_if(F.col("vec_id") % 13 == 0).alias("noise"))
    return T.run_status(pages.crossJoin(it).crossJoin(e))

