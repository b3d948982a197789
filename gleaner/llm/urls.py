"""URL filters: all glob rules at once by a bit-parallel wildcard automaton.

A rule's globs are matched against the canonical URL, host + path, as bytes.
``**`` stands for any text, ``*`` for any text without a slash (so a host's
``*`` never reaches into the path). The states of all globs lie side by side in
64-bit words: a byte moves every state that reads it one bit up (Shift-And),
and a state before a wildcard keeps itself alive. A batch of URLs advances
together, one column of bytes at a time.

Of the rules that match a URL the longest (host + path as written) decides, of
equally long ones a block. Where no rule matches, the method's own globs
decide: ``JUNK`` blocks, all else is allowed.

Edge cases: null URLs and such without ``://`` have an empty host and path and
match nothing; repeated rows are judged each; very long URLs are whole. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: (verdict, host, path): a rule holds for the host and its subdomains where the path starts so.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The method's globs for URLs without a rule: advertising hosts, account pages, binary files.
JUNK = ("ads.*/**", "ad.*/**", "*.ads.*/**", "tracker.*/**", "*/login**", "*/**/login**", "*/cart/**", "*/**/cart/**",
        "*/**.exe", "*/**.zip", "*/**.apk")
ROWS, CELLS = 4096, 1 << 22
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_globs(host: str, path: str) -> tuple[str, str]:
    return f"{host}{path}**", f"*.{host}{path}**"


class Automaton:
    """Globs packed into ``words`` 64-bit words of states."""

    def __init__(self, globs: list[str]):
        parsed, at = [], 0
        for g in globs:
            steps, i, raw = [], 0, g.encode()
            while i < len(raw):
                n = 2 if raw[i:i + 2] == b"**" else 1
                steps.append("any" if n == 2 else "label" if raw[i:i + 1] == b"*" else raw[i])
                i += n
            parsed.append((at, steps))
            at += 1 + sum(isinstance(s, int) for s in steps)
        self.words = max(1, -(-at // 64))
        self.move, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.final = np.zeros(self.words, np.uint64), []
        for bit, steps in parsed:
            self._set(self.start, bit)
            for s in steps:
                if isinstance(s, int):
                    self._set(self.move[s], bit)
                    bit += 1
                else:
                    for c in range(256):
                        if s == "any" or c != 47:
                            self._set(self.stay[c], bit)
            self.final.append(bit)

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(text, glob) -> whether it matches, for all globs at once."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        i = 0
        while i < len(order):
            n = max(1, min(ROWS, CELLS // max(1, len(texts[order[i]]))))
            part, i = order[i:i + n], i + n
            out[part] = self._advance([texts[k] for k in part])
        return out

    def _advance(self, texts: list[bytes]) -> np.ndarray:
        """Texts in descending order of length."""
        sizes = np.array([len(t) for t in texts])
        chars = np.zeros((len(texts), int(sizes.max(initial=0))), np.uint8)
        for k, t in enumerate(texts):
            chars[k, :len(t)] = np.frombuffer(t, np.uint8)
        state = np.tile(self.start, (len(texts), 1))
        for j in range(chars.shape[1]):
            n = int(np.searchsorted(-sizes, -j))  # those longer than j
            s, c = state[:n], chars[:n, j]
            go = s & self.move[c]
            up = go << np.uint64(1)
            up[:, 1:] |= go[:, :-1] >> np.uint64(63)
            state[:n] = up | (s & self.stay[c])
        f = np.array(self.final)
        return (state[:, f >> 6] >> (f & 63).astype(np.uint64)) & np.uint64(1) != 0


def judge(pages: DataFrame, rules=RULES, junk=JUNK) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    prepare(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    globs = [g for _, host, path in ranked for g in rule_globs(host, path)]
    automaton = Automaton([*globs, *junk])
    names, verdicts = [h + p for _, h, p in ranked], [v for v, _, _ in ranked]

    def run(batches):
        for b in batches:
            url = [(h + p).encode() for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            m = automaton.matches(url)
            hit = m[:, :len(globs)].reshape(len(url), len(names), 2).any(axis=2)
            first = np.where(hit.any(axis=1), hit.argmax(axis=1) if names else 0, -1)
            bad = m[:, len(globs):].any(axis=1)
            rule = pa.array([names[k] if k >= 0 else None for k in first], pa.string())
            verdict = pa.array([verdicts[k] if k >= 0 else "block" if x else "allow" for k, x in zip(first, bad)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), rule, verdict],
                                             ["page_id", "host", "path", "rule", "verdict"])
    part = lambda k: F.coalesce(F.regexp_extract("url", "://([^/?#]*)([^?#]*)", k), F.lit(""))
    parts = pages.select("page_id", F.translate(part(1), _UP, _LOW).alias("host"), part(2).alias("path"))
    kind = dict(pages.dtypes)["page_id"]
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")




def _sql_glob(g: str) -> str:
    from re import escape
    return "^" + escape(g).replace(r"\*\*", "(?s:.)*").replace(r"\*", "[^/]*") + "$"


_SORTED = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
_FITS = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in _SORTED]
ORACLE = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(_FITS, _SORTED))} END AS rule,
  CASE {' '.join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(_FITS, _SORTED))}
    WHEN {' OR '.join(f"regexp_matches(host || path, '{_sql_glob(g)}')" for g in JUNK)} THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""
