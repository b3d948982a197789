"""DuckDB SQL fragments for the oracles (the independent engine in the checks)."""

from __future__ import annotations

from collections.abc import Sequence


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def any_pattern(text: str, patterns: Sequence[str]) -> str:
    parts = [f"regexp_matches({text}, {q(p)})" if ".*" in p else f"contains({text}, {q(p)})" for p in patterns]
    return "(" + " OR ".join(parts or ["FALSE"]) + ")"


def any_substring(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join([f"contains({text}, {q(w)})" for w in words] or ["FALSE"]) + ")"


def count_judgment(judgment: str, min_reason: int | None = None, col: str = "axiom_check") -> str:
    cond = f"x.judgment = {q(judgment)}"
    if min_reason is not None:
        cond += f" AND length(x.reason) > {min_reason}"
    return f"len(list_filter(coalesce({col}, []), lambda x: {cond}))"


def normalise_headline(c: str) -> str:
    x = f"regexp_replace(lower({c}), '^[\\s\\v]+|[\\s\\v]+$', '', 'g')"
    x = f"regexp_replace({x}, '[^a-z0-9\\s\\v]', '', 'g')"
    return f"regexp_replace({x}, '[\\s\\v]+', ' ', 'g')"
