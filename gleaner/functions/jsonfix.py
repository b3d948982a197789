"""Model-response text → JSON → item rows.

All steps are built-in expressions except the string sanitiser, which needs
a quote-aware scan and runs as an Arrow-batched pandas UDF over C-level
regular expressions (no per-character Python loop).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim_ws

# FIXED VALUES — required keys of an extracted item
REQUIRED_KEYS_FULL = [
    'master_headline', 'headline', 'short_description',
    'source', 'date', 'companies', 'technologies',
    'reality_status', 'reality_reason',
    'axiom_check', 'violations',
    'regional_implications', 'linkedin_angle',
]
REQUIRED_KEYS_SIMPLE = [
    'master_headline', 'headline', 'short_description',
    'source', 'date', 'companies', 'technologies',
    'regional_implications', 'linkedin_angle',
]

# FIXED VALUES — newsletter brief messages
MSG_NO_CONTENT = "No relevant content found."
MSG_NO_WELL_FORMED = "No well-formed relevant items found."
MSG_PARSE_FAILED = "Summary failed to parse as JSON."


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a plain expression would be copied
    into every place that ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_code_fence(c: str | Column) -> Column:
    """Drop a leading ``` line and, if the last line is ```, that line too; then strip."""
    def unfenced(t: Column) -> Column:
        return F.when(t.startswith("```"), _let(F.split(t, "\n"), inside)).otherwise(t)

    def inside(lines: Column) -> Column:
        n = F.size(lines)
        last_is_fence = F.trim(F.element_at(lines, -1)) == "```"
        body = (F.when(n <= 1, F.array().cast("array<string>"))
                 .when(last_is_fence, F.slice(lines, 2, F.greatest(n - 2, F.lit(0))))
                 .otherwise(F.slice(lines, 2, n - 1)))
        return trim_ws(F.array_join(body, "\n"))

    return _let(trim_ws(_col(c)), unfenced)


# a JSON string literal: an opening quote, escape pairs or plain characters, then a
# closing quote or the end of the text (a trailing lone backslash is kept)
_STRING = re.compile(r'"((?:[^"\\]++|\\.|\\\Z)*+)("|\Z)', re.S)
_RAW_IN_STRING = re.compile(r'(\\.)|\n|\r|\t', re.S)
_RAW = re.compile(r'[\n\r\t]')
_ESC = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def sanitize_text(text: str | None) -> str | None:
    """Escape raw newline, CR and tab inside JSON strings only."""
    if text is None or not _RAW.search(text):
        return text

    def fix_inner(m: re.Match) -> str:
        return m.group(1) if m.group(1) is not None else _ESC[m.group(0)]

    def fix_string(m: re.Match) -> str:
        inner = m.group(1)
        return m.group(0) if not _RAW.search(inner) else '"' + _RAW_IN_STRING.sub(fix_inner, inner) + m.group(2)

    return _STRING.sub(fix_string, text)


def _sanitize_series(s: pd.Series) -> pd.Series:
    return s.map(sanitize_text)


@functools.lru_cache(maxsize=1)
def _sanitize_udf():
    return F.pandas_udf(_sanitize_series, "string")


def sanitize_json_strings(c: str | Column) -> Column:
    """T10, vectorised over Arrow batches (the UDF is built on the driver at call
    time, so importing this module on an executor creates nothing)."""
    return _sanitize_udf()(_col(c))


def _between(text: str, first: str, last: str) -> str | None:
    """From the first ``first`` to the last ``last`` after it."""
    i, j = text.find(first), text.rfind(last)
    return text[i:j + 1] if 0 <= i < j else None


_ATTEMPTS = ("san", "arr", "arr_san", "obj", "obj_san")


def _attempts_series(s: pd.Series) -> pd.DataFrame:
    """T11's texts after the direct one; null where a text equals an earlier one."""
    rows = []
    for text in s:
        row = [None] * 5
        if text is not None:
            arr, obj = _between(text, "[", "]"), _between(text, "{", "}")
            seen = {text}
            for i, x in enumerate((sanitize_text(text), arr, sanitize_text(arr), obj, sanitize_text(obj))):
                if x is not None and x not in seen:
                    seen.add(x)
                    row[i] = x
        rows.append(row)
    return pd.DataFrame(rows, columns=_ATTEMPTS, dtype=object)


@functools.lru_cache(maxsize=1)
def _attempts_udf():
    return F.pandas_udf(_attempts_series, "struct<" + ",".join(f"{n}:string" for n in _ATTEMPTS) + ">")


def repair_parse_json(c: str | Column, expect_list: bool = True) -> Column:
    """The first candidate that parses, as JSON text; a lone object becomes a
    one-element list when a list is expected; null when nothing parses.

    Candidates in order: direct, sanitised, array then object extraction (each
    raw then sanitised), trailing commas removed from the sanitised text.
    """
    t = strip_code_fence(c)

    def parsed(x: Column) -> Column:
        r = F.struct(x.alias("text"), F.schema_of_variant(F.try_parse_json(x)).alias("kind"))
        return _let(r, lambda v: F.when(v["kind"].isNotNull(), v))

    def first_valid(s: Column) -> Column:
        tried = [s["t"], *[s["more"][n] for n in _ATTEMPTS]]
        no_commas = F.regexp_replace(F.coalesce(s["more"]["san"], s["t"]), r",\s*([}\]])", "$1")
        return F.coalesce(*[parsed(x) for x in tried], parsed(no_commas))

    def listed(r: Column) -> Column:
        if not expect_list:
            return r["text"]
        return F.when(r["kind"].startswith("OBJECT"), F.concat(F.lit("["), r["text"], F.lit("]"))).otherwise(r["text"])

    return _let(_let(F.struct(t.alias("t"), _attempts_udf()(t).alias("more")), first_valid), listed)


def extract_item_json(c: str | Column) -> Column:
    """Greedy {…} block wrapped as a list, else the bare list, else the first […], else the text."""
    def pick(s: Column) -> Column:
        return (F.when(s["obj"] != "", F.concat(F.lit("["), trim_ws(s["obj"]), F.lit("]")))
                 .when(s["tt"].startswith("[") & s["tt"].endswith("]"), s["tt"])
                 .otherwise(_let(F.regexp_extract(s["tt"], r"(?s)\[.*\]", 0),
                                 lambda lst: F.when(lst != "", trim_ws(lst)).otherwise(s["tt"]))))

    t = _col(c)
    return _let(F.struct(F.regexp_extract(t, r"(?s)(\{.*\})", 1).alias("obj"), trim_ws(t).alias("tt")), pick)


def parse_items(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Strict parse of T12's text into ``maps ARRAY<MAP<STRING,STRING>>`` (nested values
    stay JSON text; null when the text is not valid JSON or not a list of objects) and
    ``_ok`` (valid JSON).  The text is extracted once, checked once and read once."""
    def read(r: Column) -> Column:
        wrapped = F.when(r["kind"].startswith("OBJECT"), F.concat(F.lit("["), r["js"], F.lit("]"))).otherwise(r["js"])
        ok = r["kind"].isNotNull()
        return F.struct(ok.alias("ok"), F.when(ok, F.from_json(wrapped, "array<map<string,string>>")).alias("maps"))

    checked = _let(extract_item_json(text_col), lambda js: F.struct(
        js.alias("js"), F.schema_of_variant(F.try_parse_json(js)).alias("kind")))
    return (df.withColumn("_parsed", _let(checked, read))
              .withColumn("_ok", F.col("_parsed.ok")).withColumn("maps", F.col("_parsed.maps")).drop("_parsed"))


def explode_items(parsed: DataFrame, id_col: str, required: Sequence[str] = REQUIRED_KEYS_FULL) -> DataFrame:
    """T13 + T14: one row per object with its position, ``valid`` (all keys present,
    null values allowed) and ``missing_keys``."""
    req = F.array(*[F.lit(k) for k in required])
    # the outer form: the plain one would test the list in a filter of its own, parsing it again
    ex = parsed.select(id_col, F.posexplode_outer("maps").alias("pos", "m")).filter(F.col("pos").isNotNull())
    return ex.withColumn("missing_keys", F.array_except(req, F.coalesce(F.map_keys("m"), F.array().cast("array<string>")))) \
             .withColumn("valid", F.size("missing_keys") == 0)
