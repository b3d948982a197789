"""Column expressions for text: pattern tests, keys, cleaning.

All of these are built-in Spark SQL expressions, so they stay inside
whole-stage codegen and are evaluated on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_pattern(text: str | Column, patterns: Sequence[str]) -> Column:
    """True when any pattern hits ``text``.

    A pattern holding ``.*`` is a regex search (``.`` stops only at ``\\n``,
    as in Python); every other pattern is a plain substring test.
    """
    t = _col(text)
    tests = []
    for p in patterns:
        if ".*" in p:
            tests.append(t.rlike("(?d)" + p))
        else:
            tests.append(F.instr(t, p) > 0)
    if not tests:
        return F.lit(False)
    return reduce(lambda a, b: a | b, tests)


def any_substring(text: str | Column, words: Sequence[str]) -> Column:
    """True when any word occurs as a substring (so 'bid' hits 'forbidden')."""
    t = _col(text)
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.instr(t, w) > 0 for w in words])


def joined_lower(*cols: str | Column) -> Column:
    """lower(c1 || ' ' || c2 ...) with nulls read as ''."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(_col(c), F.lit("")) for c in cols]))


def normalise_headline(c: str | Column) -> Column:
    """Lower, trim, keep [a-z0-9] and whitespace, collapse whitespace."""
    x = F.regexp_replace(F.lower(_col(c)), r"(?U)^\s+|\s+$", "")
    x = F.regexp_replace(x, r"(?U)[^a-z0-9\s]", "")
    return F.regexp_replace(x, r"(?U)\s+", " ")


def token_set(c: str | Column) -> Column:
    """Distinct non-empty words of a normalised key."""
    return F.array_distinct(F.filter(F.split(_col(c), " "), lambda w: w != ""))


def collapse_space(c: str | Column) -> Column:
    """Runs of space/tab → one space; three or more newlines → two."""
    x = F.regexp_replace(_col(c), "[ \\t]+", " ")
    return F.regexp_replace(x, "\\n{3,}", "\n\n")


def strip_rules(c: str | Column, rules: Sequence[str]) -> Column:
    """Ordered case-blind deletions, then trim of whitespace."""
    x = _col(c)
    for r in rules:
        x = F.regexp_replace(x, "(?iud)" + r, "")
    return trim_ws(x)


def trim_ws(c: str | Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(_col(c), r"^[ \t\n\r\f\u000b]+|[ \t\n\r\f\u000b]+$", "")


def truncate(c: str | Column, n: int, ellipsis: bool = False) -> Column:
    """First n characters of a possibly null string ('' for null)."""
    x = F.substring(F.coalesce(_col(c), F.lit("")), 1, n)
    if ellipsis:
        return F.when(F.length(F.coalesce(_col(c), F.lit(""))) > n, F.concat(x, F.lit("..."))).otherwise(x)
    return x
