"""Text operators of the digest: mail extraction, cleaning, chunking, item fields, briefs.

All narrow projections over built-in expressions except where noted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.jsonfix import MSG_NO_CONTENT, MSG_NO_WELL_FORMED, MSG_PARSE_FAILED
from ..functions.text import collapse_space, strip_rules, trim_ws
from .series import prefix_agg


# ---------------------------------------------------------------------------
# S01–S03 mail
# ---------------------------------------------------------------------------
def scan_recent(mail: DataFrame, label: str, as_of_day, days_back: int = 7) -> DataFrame:
    """One label, received after the cutoff day (``after:yyyy/MM/dd`` is exclusive
    of nothing before that day: messages on or after the cutoff day)."""
    cutoff = F.date_sub(F.lit(as_of_day).cast("date") if not isinstance(as_of_day, Column) else as_of_day, days_back)
    return mail.filter((F.col("label") == label) & (F.col("received_day") >= cutoff))


def header_value(headers: Column, name: str, default: str) -> Column:
    """First header with this name, else the default."""
    return F.coalesce(F.get(F.filter(headers, lambda h: h["name"] == name), 0)["value"], F.lit(default))


def _b64url_decode(data: Column) -> Column:
    """Null where the bytes are not UTF-8."""
    return F.try_validate_utf8(F.unbase64(F.translate(data, "-_", "+/")).cast("string"))


def extract_html_body(payload: Column) -> Column:
    """First text/html part at top level or one level down, else the root body
    when the root itself is text/html; base64url → UTF-8; '' when none, null when the
    body is not UTF-8."""
    parts = payload["parts"]
    part_t = ("array<struct<mimeType:string,body:struct<data:string>,"
              "parts:array<struct<mimeType:string,body:struct<data:string>>>>>")
    per_part = F.transform(F.coalesce(parts, F.array().cast(part_t)),
                           lambda p: F.when((p["mimeType"] == "text/html") & p["body"].isNotNull(),
                                            F.array(p["body"]["data"]))
                           .otherwise(F.transform(F.filter(F.coalesce(p["parts"], F.array().cast(
                               "array<struct<mimeType:string,body:struct<data:string>>>")),
                               lambda s: (s["mimeType"] == "text/html") & s["body"].isNotNull()),
                               lambda s: s["body"]["data"])))
    found = F.get(F.filter(F.flatten(per_part), lambda d: d.isNotNull() & (d != "")), 0)
    root = F.when(parts.isNull() & (payload["mimeType"] == "text/html"), payload["body"]["data"])
    data = F.when(parts.isNotNull(), found).otherwise(root)
    return F.when(data.isNull(), F.lit("")).otherwise(_b64url_decode(data))


def mail_rows(mime_df: DataFrame) -> DataFrame:
    """S02 + S03: (id, subject, sender, body_html); rows without a body are dropped."""
    p = F.col("payload")
    return mime_df.select(
        "id", header_value(p["headers"], "Subject", "No Subject").alias("subject"),
        header_value(p["headers"], "From", "No Sender").alias("sender"),
        extract_html_body(p).alias("body_html")).filter(F.col("body_html") != "")


def mail_rejects(mime_df: DataFrame) -> DataFrame:
    """(id, reason) of the mails whose HTML body is not UTF-8."""
    return mime_df.filter(extract_html_body(F.col("payload")).isNull()).select("id", F.lit("body is not UTF-8").alias("reason"))


# ---------------------------------------------------------------------------
# T02–T08 cleaning, size, chunks
# ---------------------------------------------------------------------------
def clean_text(c: str | Column, rules: Sequence[str] = P.BOILERPLATE_RULES) -> Column:
    """T02 then T03."""
    return strip_rules(collapse_space(c), rules)


def estimate_tokens(c: str | Column) -> Column:
    """Characters / 4."""
    x = F.col(c) if isinstance(c, str) else c
    return F.length(x) / 4.0


def needs_chunking(tokens: Column, limit: int = 1_048_575, share: float = 0.9) -> Column:
    """Tokens above share × limit."""
    return tokens > F.lit(limit * share)


def chunk_text(df: DataFrame, text_col: str, key: str, size: int, overlap: int) -> DataFrame:
    """T06 (fixed windows): chunks of ``size`` characters starting every size − overlap."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.length(text_col), F.lit(1)), F.lit(step))
    ex = df.select(key, text_col, F.posexplode(starts).alias("pos", "start"))
    return ex.select(key, "pos", F.substring(F.col(text_col), F.col("start"), F.lit(size)).alias("chunk"))


def combine_chunks(chunks: DataFrame, key: str, pos: str = "pos", text: str = "chunk",
                   limit_chars: int | None = None) -> DataFrame:
    """Per document, chunk texts joined in order with '\\n\\n---\\n\\n' (cut when too long)."""
    g = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
                                .alias("_c"))
    joined = F.array_join(F.transform("_c", lambda s: s["t"]), "\n\n---\n\n")
    if limit_chars is not None:
        joined = F.substring(joined, 1, limit_chars)
    return g.select(key, joined.alias("combined"))


# ---------------------------------------------------------------------------
# T15–T18, T21, T22 item fields
# ---------------------------------------------------------------------------
def flatten_violations(v: Column) -> list[Column]:
    """Count (0 default) and the two lists joined with '; '."""
    return [F.coalesce(v["count"], F.lit(0)).alias("violation_count"),
            F.array_join(F.coalesce(v["top_violations"], F.array().cast("array<string>")), "; ").alias("top_violations_formatted"),
            F.array_join(F.coalesce(v["minimal_repair"], F.array().cast("array<string>")), "; ").alias("minimal_repairs_formatted")]


def flatten_regions(m: Column) -> list[Column]:
    """The four region columns; null or missing → ''."""
    g = lambda k: F.coalesce(F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")), F.lit(""))
    return [g("US").alias("region_us"), g("EU").alias("region_eu"), g("CN").alias("region_cn"),
            g("ASIA").alias("region_asia")]


def resolve_source(source: Column, sender: Column) -> Column:
    """Own source unless null/''/'N/A'; else sender text before '<' (trimmed);
    else the sender; else 'N/A'."""
    own = F.when(F.coalesce(source, F.lit("")).isin("", "N/A"), F.lit(None)).otherwise(source)
    before = F.when(F.instr(F.coalesce(sender, F.lit("")), "<") > 0, trim_ws(F.substring_index(sender, "<", 1)))
    return F.coalesce(own, before, F.when(F.coalesce(sender, F.lit("")) != "", sender), F.lit("N/A"))


def resolve_date(date: Column, run_date: Column) -> Column:
    """The run date when the date is null, '' or 'N/A'."""
    return F.when(F.coalesce(date, F.lit("")).isin("", "N/A"), run_date).otherwise(date)


def select_text(field: Column, headline: Column, master: Column, fallback: str = "No content available") -> Column:
    """Trimmed text if non-blank; else headline + ' ' + master headline trimmed; else a constant."""
    t = trim_ws(F.coalesce(field, F.lit("")))
    fb = trim_ws(F.concat(F.coalesce(headline, F.lit("")), F.lit(" "), F.coalesce(master, F.lit(""))))
    return F.when(t != "", t).when(fb != "", fb).otherwise(F.lit(fallback))


def to_list(c: Column) -> Column:
    """Comma string → trimmed non-empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


# ---------------------------------------------------------------------------
# T27–T34
# ---------------------------------------------------------------------------
def content_key(model: str | Column, text: Column) -> Column:
    """sha256 of model ':' text (per text, so a permuted batch still hits)."""
    m = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat_ws(":", m, text), 256)


def prompt_list(dim: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Numbered lines 'id. text' joined by newlines in id order (one row)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t")))),
                        lambda x: F.concat(x["i"].cast("string"), F.lit(". "), x["t"]))
    return dim.agg(F.array_join(lines, "\n").alias("prompt_list"))


def compact_payload(df: DataFrame, group: str, order: str, fields: dict[str, Column]) -> DataFrame:
    """Per group a JSON array of the chosen (truncated) fields in order."""
    st = F.struct(F.col(order).alias("_o"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_v"))
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(st)).alias("_a"))
    return g.select(group, F.to_json(F.transform("_a", lambda s: s["_v"])).alias("payload"))


def cluster_text(df: DataFrame, key: str = "cluster_id", order: str = "ord", page_chars: int = 1 << 20) -> DataFrame:
    """Per cluster a bullet list '- headline: description' in input order, in pages:
    (key, page, cluster_text).

    A page holds the lines that start within its ``page_chars`` characters of the list, so
    no task or row holds more than that and one line; the pages of a cluster joined by line
    feeds are the whole list.  Running lengths come from ``prefix_agg``, which splits a
    large cluster; ``order`` must be unique within a cluster."""
    line = F.concat(F.lit("- "), F.coalesce("headline", F.lit("")), F.lit(": "), F.coalesce("short_description", F.lit("")))
    rows = df.select(key, F.col(order).alias("_o"), line.alias("_line")).withColumn("_size", F.length("_line").cast("long") + 1)
    at = prefix_agg(rows, [key], ["_o"], None, {"_end": ("sum", "_size")})
    page = F.floor((F.col("_end") - F.col("_size")) / page_chars)
    g = at.groupBy(key, page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("_o", "_line"))).alias("_l"))  # a page
    return g.select(key, "page", F.array_join(F.transform("_l", lambda s: s["_line"]), "\n").alias("cluster_text"))


def format_theses(ids: Column, scores: Column | None = None) -> list[Column]:
    """Id list → '1, 3, 6'; score map → '1:10, 3:9' (keys in order)."""
    out = [F.array_join(F.transform(ids, lambda x: x.cast("string")), ", ").alias("theses_formatted")]
    if scores is not None:
        out.append(F.array_join(F.transform(F.array_sort(F.map_entries(scores)),
                                            lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")
                   .alias("scores_formatted"))
    return out


def newsletter_brief(parsed: DataFrame, exploded: DataFrame, id_col: str) -> DataFrame:
    """T33 + G05: per newsletter the relevance score (90 with ≥ 1 valid item, else 0)
    and the brief (first valid item's description, else a fixed message)."""
    valid = exploded.filter("valid").groupBy(id_col).agg(
        F.min_by(F.coalesce(F.try_element_at("m", F.lit("short_description")), F.lit("N/A")), "pos").alias("first_desc"),
        F.count(F.lit(1)).alias("valid_items"))
    n = exploded.groupBy(id_col).agg(F.count(F.lit(1)).alias("parsed_items"))
    j = parsed.select(id_col, "_ok").join(valid, id_col, "left").join(n, id_col, "left")
    brief = (F.when(~F.col("_ok"), F.lit(MSG_PARSE_FAILED))
              .when(F.coalesce(F.col("valid_items"), F.lit(0)) > 0, F.col("first_desc"))
              .when(F.coalesce(F.col("parsed_items"), F.lit(0)) == 0, F.lit(MSG_NO_CONTENT))
              .otherwise(F.lit(MSG_NO_WELL_FORMED)))
    return j.select(id_col, F.when(F.coalesce(F.col("valid_items"), F.lit(0)) > 0, F.lit(90)).otherwise(F.lit(0))
                    .alias("relevance_score"), brief.alias("brief"))


def relevance_floor(briefs: DataFrame, floor: int = 50) -> DataFrame:
    """Newsletters whose score reaches the floor."""
    return briefs.filter(F.col("relevance_score") >= floor)


def run_status(counts: DataFrame) -> DataFrame:
    """One status line from the run's counts."""
    return counts.select(F.format_string(
        "Processed %d newsletters, %d items kept of %d; %d clusters, %d noise items",
        "newsletters", "kept", "items", "clusters", "noise").alias("status"))

