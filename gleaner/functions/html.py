"""HTML → text.

``html_to_text`` is the JVM-side form (regular expressions, whole-stage
codegen): drop script/style blocks and comments, turn every tag into a line
break, decode character references (numeric, and the standard's names), strip each
line and drop empty ones.  ``html_to_text_exact`` runs the standard-library
HTML tokenizer in an Arrow-batched UDF for pages whose markup the regular
form cannot read (stray '<' in text).
"""

from __future__ import annotations

import functools
import json
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES — frequent named entities, decoded first (name, character)
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&rsquo;", "’"),
    ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&euro;", "€"),
    ("&trade;", "™"), ("&bull;", "•"),
]

_BLOCKS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
_TAG = r"<[a-zA-Z/!?][^>]*>"


# what is left of character references once the names above are decoded; &amp; comes last
_REFERENCE = "&(?:#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6})|(?!amp;)[a-zA-Z][a-zA-Z0-9]{1,31});"


@functools.lru_cache(maxsize=1)
def _standard_names() -> str:
    """The standard's named character references, as the standard library has them, in JSON."""
    return json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})


def _references(x: Column) -> Column:
    """Decimal, hexadecimal and standard named character references decoded; numbers that are no
    character become U+FFFD, unknown names stay."""
    names = F.from_json(F.lit(_standard_names()), "map<string,string>")

    def char(ref: Column) -> Column:
        body = F.substring(ref, F.lit(3), F.length(ref) - 3)
        is_hex = F.lower(F.substring(body, 1, 1)) == "x"
        number = F.when(is_hex, F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).cast("long")
        bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        code = F.when(bad, F.lit(0xFFFD)).otherwise(number)
        named = F.coalesce(F.try_element_at(names, F.substring(ref, F.lit(2), F.length(ref) - 2)), ref)
        return F.when(F.substring(ref, 2, 1) == "#", F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(named)
    pieces = F.split(x, _REFERENCE, -1)
    refs = F.concat(F.transform(F.regexp_extract_all(x, F.lit(_REFERENCE), F.lit(0)), char), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, refs, lambda p, r: F.concat(p, r)), "")


def html_to_text(c: str | Column) -> Column:
    """T01, JVM-side form."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(x, _BLOCKS, "\n")
    x = F.regexp_replace(x, _TAG, "\n")
    for name, ch in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(ch))
    x = F.when(x.rlike(_REFERENCE), _references(x)).otherwise(x)
    x = F.replace(x, F.lit("&amp;"), F.lit("&"))
    lines = F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


class _TextCollector(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.buf: list[str] = []
        self.skip = 0

    def _flush(self):
        if self.buf:
            s = "".join(self.buf).strip()
            if s:
                self.parts.append(s)
            self.buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in ("script", "style"):
            self.skip += 1

    def handle_endtag(self, tag):
        self._flush()
        if tag in ("script", "style") and self.skip:
            self.skip -= 1

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_data(self, data):
        if not self.skip:
            self.buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()


def html_text_exact(html: str | None) -> str:
    if not html:
        return ""
    p = _TextCollector()
    p.feed(html)
    p.close()
    p._flush()
    return "\n".join(p.parts)


def _html_series(s: pd.Series) -> pd.Series:
    return s.map(html_text_exact)


@functools.lru_cache(maxsize=1)
def _html_udf():
    return F.pandas_udf(_html_series, "string")


def html_to_text_exact(c: str | Column) -> Column:
    """T01 with the standard-library tokenizer (Arrow batches)."""
    return _html_udf()(F.col(c) if isinstance(c, str) else c)
