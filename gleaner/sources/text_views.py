"""Text-side views over ``pages`` and ``documents``, in Spark and DuckDB form.

* newsletters — one mail per page: subject from <title>, sender from the host.
* mime — the same mail as a MIME tree (root html, html as part 2, html nested
  one level down, or no html at all).
* footer_text — document text plus one boilerplate footer line.
* responses — a stored model response per document: the item as JSON,
  wrapped six ways (list, bare object, fenced, raw newline in a string,
  trailing comma, one required key missing).
* verdicts — a verdict per item keyed by its headline (exact, a 12-character
  prefix, or absent).
* store — embedding-store entries keyed by sha256(model:text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import items
from .tables import table

# FIXED VALUES — one footer line per boilerplate rule, in rule order
FOOTER_LINES = [
    "View this email in your browser: https://news.example.com/view",
    "Unsubscribe from this list",
    "If you no longer wish to receive these emails, update your settings",
    "Copyright 2024 Example Media. All rights reserved.",
    "Sent by: Example Media, 1 Main Street",
    "Your privacy is important to us. Read our policy.",
    "Manage Preferences | Unsubscribe",
    "Read this email in your browser",
    "Having trouble viewing this email? View it in your browser.",
    "Click here to unsubscribe",
    "To ensure delivery, please add news@example.com to your address book.",
    "Forward to a friend",
    "If this email is not displaying correctly, you can view it here",
    "To view this email as a web page, click here. Thanks",
]

STORE_MODEL = "all-MiniLM-L6-v2"


def _lit_array(values):
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _duck_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---------------------------------------------------------------------------
def newsletters(spark: SparkSession, sf: str) -> DataFrame:
    pg = table(spark, sf, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return pg.select(
        F.col("page_id").alias("id"),
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("subject"),
        F.concat(host, F.lit(" <news@"), host, F.lit(">")).alias("sender"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 20).cast("int")).alias("received_day"),
        F.when(F.col("page_id") % 3 == 0, F.lit("other")).otherwise(F.lit("newsletters")).alias("label"),
        F.col("html").alias("body_html"))


NEWSLETTERS_DUCK = """
newsletters AS (
  SELECT page_id AS id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS subject,
         regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || ' <news@' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || '>' AS sender,
         DATE '2024-01-01' + CAST(page_id % 20 AS INTEGER) AS received_day,
         CASE WHEN page_id % 3 = 0 THEN 'other' ELSE 'newsletters' END AS label, html AS body_html
  FROM pages
)"""


def _b64url(c):
    return F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_")


def mime(spark: SparkSession, sf: str) -> DataFrame:
    """MIME payloads: page_id % 4 = 0 root html, 1 html second part, 2 nested, 3 no html."""
    nl = newsletters(spark, sf)
    leaf = lambda mt, data: F.struct(F.lit(mt).alias("mimeType"), F.struct(data.alias("data")).alias("body"))
    html = _b64url(F.col("body_html"))
    plain = _b64url(F.col("subject"))
    inner_t = "array<struct<mimeType:string,body:struct<data:string>>>"
    part = lambda mt, data, sub: F.struct(F.lit(mt).alias("mimeType"),
                                          F.struct(data.alias("data")).alias("body"), sub.alias("parts"))
    no_sub = F.lit(None).cast(inner_t)
    headers = F.filter(F.array(F.struct(F.lit("Subject").alias("name"), F.col("subject").alias("value")),
                               F.struct(F.lit("From").alias("name"), F.col("sender").alias("value"))),
                       lambda h: (h["name"] != "Subject") | (F.col("id") % 5 != 0))
    k = F.col("id") % 4
    parts = (F.when(k == 1, F.array(part("text/plain", plain, no_sub), part("text/html", html, no_sub)))
              .when(k == 2, F.array(part("multipart/alternative", F.lit(None).cast("string"),
                                         F.array(leaf("text/plain", plain), leaf("text/html", html)))))
              .when(k == 3, F.array(part("text/plain", plain, no_sub))))
    root_type = F.when(k == 0, "text/html").when(k == 3, "multipart/mixed").otherwise("multipart/alternative")
    root_body = F.when(k == 0, F.struct(html.alias("data"))).otherwise(F.lit(None).cast("struct<data:string>"))
    return nl.select("id", F.struct(root_type.alias("mimeType"), headers.alias("headers"), root_body.alias("body"),
                                    parts.alias("parts")).alias("payload"))


# ---------------------------------------------------------------------------
def footer_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat("text", F.lit("\n"),
                                       F.expr(f"element_at({_lit_array(FOOTER_LINES)}, cast(doc_id % 14 + 1 AS int))"))
                    .alias("text"))


FOOTER_DUCK = f"""
footer_text AS (SELECT doc_id, text || chr(10) || {_duck_list(FOOTER_LINES)}[doc_id % 14 + 1] AS text FROM documents)"""


# ---------------------------------------------------------------------------
_AX_SPARK = ("CASE WHEN axiom_check IS NULL THEN 'null' ELSE concat('{', array_join(transform(axiom_check, x -> "
             "concat('\"', x.axiom_id, '\":{\"judgment\":\"', x.judgment, '\",\"reason\":\"', x.reason, '\"}')), ','), '}') END")
_REG_SPARK = ("concat('{\"US\":\"us ', ord % 5, '\"', CASE WHEN ord % 2 = 0 THEN concat(',\"EU\":\"eu ', ord % 3, '\"') ELSE '' END, "
              "CASE WHEN ord % 3 = 0 THEN ',\"CN\":null' ELSE concat(',\"CN\":\"cn ', ord % 4, '\"') END, '}')")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    base_cols = ["master_headline", "headline", "short_description", "source", "date", "companies",
                 "technologies", "reality_status", "reality_reason"]
    tail = F.concat(F.lit(',"axiom_check":'), F.expr(_AX_SPARK), F.lit(',"violations":'),
                    F.to_json(F.struct(F.col("violation_count").alias("count"),
                                       F.col("violations.top_violations").alias("top_violations"),
                                       F.col("violations.minimal_repair").alias("minimal_repair"))),
                    F.lit(',"regional_implications":'), F.expr(_REG_SPARK), F.lit("}"))
    it = (items(spark, sf)
          .withColumn("_j1", F.to_json(F.struct(*base_cols, "linkedin_angle")))
          .withColumn("_j0", F.to_json(F.struct(*base_cols)))
          .withColumn("_tail", tail))
    open_obj = lambda j: F.substring(F.col(j), F.lit(1), F.length(j) - 1)
    obj = F.concat(open_obj("_j1"), F.col("_tail"))
    obj_missing = F.concat(open_obj("_j0"), F.col("_tail"))
    k = F.col("ord") % 6
    text = (F.when(k == 0, F.concat(F.lit("["), obj, F.lit("]")))
             .when(k == 1, obj)
             .when(k == 2, F.concat(F.lit("```json\n["), obj, F.lit("]\n```")))
             .when(k == 3, F.concat(F.lit("["), F.replace(obj, F.lit('"headline":"'), F.lit('"headline":"\n')), F.lit("]")))
             .when(k == 4, F.concat(F.lit("["), obj, F.lit(",]")))
             .otherwise(F.concat(F.lit("["), obj_missing, F.lit("]"))))
    return it.select(F.col("item_id").alias("doc_id"), text.alias("response"))


def responses_table(spark: SparkSession, sf: str) -> DataFrame:
    """The responses as a persisted table (reliable checkpoint in the shared folder), as the
    pipeline keeps model output: parsing then starts from stored text, not from the
    expression that built it."""
    from ..session import cut_lineage
    return cut_lineage(responses(spark, sf))


RESPONSES_DUCK = """
resp_parts AS (
  SELECT item_id AS doc_id, ord,
    CAST(to_json({'master_headline': master_headline, 'headline': headline, 'short_description': short_description,
      'source': source, 'date': date, 'companies': companies, 'technologies': technologies,
      'reality_status': reality_status, 'reality_reason': reality_reason, 'linkedin_angle': linkedin_angle}) AS VARCHAR) AS j1,
    CAST(to_json({'master_headline': master_headline, 'headline': headline, 'short_description': short_description,
      'source': source, 'date': date, 'companies': companies, 'technologies': technologies,
      'reality_status': reality_status, 'reality_reason': reality_reason}) AS VARCHAR) AS j0,
    ',"axiom_check":' || CASE WHEN axiom_check IS NULL THEN 'null' ELSE '{' || array_to_string(list_transform(axiom_check,
        lambda x: '"' || CAST(x.axiom_id AS VARCHAR) || '":{"judgment":"' || x.judgment || '","reason":"' || x.reason || '"}'), ',') || '}' END
      || ',"violations":' || CAST(to_json({'count': violation_count, 'top_violations': top_violations, 'minimal_repair': minimal_repair}) AS VARCHAR)
      || ',"regional_implications":{"US":"us ' || CAST(ord % 5 AS VARCHAR) || '"'
      || CASE WHEN ord % 2 = 0 THEN ',"EU":"eu ' || CAST(ord % 3 AS VARCHAR) || '"' ELSE '' END
      || CASE WHEN ord % 3 = 0 THEN ',"CN":null' ELSE ',"CN":"cn ' || CAST(ord % 4 AS VARCHAR) || '"' END || '}}' AS tail
  FROM items
),
responses AS (
  SELECT doc_id, CASE ord % 6
    WHEN 0 THEN '[' || substr(j1, 1, length(j1) - 1) || tail || ']'
    WHEN 1 THEN substr(j1, 1, length(j1) - 1) || tail
    WHEN 2 THEN '```json' || chr(10) || '[' || substr(j1, 1, length(j1) - 1) || tail || ']' || chr(10) || '```'
    WHEN 3 THEN '[' || replace(substr(j1, 1, length(j1) - 1) || tail, '"headline":"', '"headline":"' || chr(10)) || ']'
    WHEN 4 THEN '[' || substr(j1, 1, length(j1) - 1) || tail || ',]'
    ELSE '[' || substr(j0, 1, length(j0) - 1) || tail || ']' END AS response
  FROM resp_parts
)"""


# ---------------------------------------------------------------------------
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf)
    k = F.col("ord") % 3
    return it.filter(k != 2).select(
        F.col("ord").alias("v_ord"),
        F.when(k == 0, F.col("headline")).otherwise(F.substring("headline", 1, 12)).alias("v_headline"),
        F.when(F.col("ord") % 2 == 0, F.lit("KEEP")).otherwise(F.lit("KILL")).alias("verdict"),
        F.concat(F.lit("r"), F.col("ord").cast("string")).alias("reason"))


VERDICTS_DUCK = """
verdicts AS (
  SELECT ord AS v_ord, CASE WHEN ord % 3 = 0 THEN headline ELSE substr(headline, 1, 12) END AS v_headline,
         CASE WHEN ord % 2 = 0 THEN 'KEEP' ELSE 'KILL' END AS verdict, 'r' || CAST(ord AS VARCHAR) AS reason
  FROM items WHERE ord % 3 <> 2
)"""


def store(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.sha2(F.concat_ws(":", F.lit(STORE_MODEL), F.col("text")), 256).alias("key"),
                    F.lit(STORE_MODEL).alias("model"), F.col("doc_id"),
                    F.col("n_chars").alias("size_bytes"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"))


STORE_DUCK = f"""
store AS (
  SELECT sha256('{STORE_MODEL}' || ':' || text) AS key, '{STORE_MODEL}' AS model, doc_id, n_chars AS size_bytes,
         TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS created_at
  FROM documents
)"""
