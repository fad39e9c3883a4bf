"""Secret scan with multipart credential linking.

Base spans, leftmost and non-overlapping per kind, whose failing matches are dropped after matching:
  assign  (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+), value of 6 or more characters
  access  AKIA[A-Z0-9]+ of 20 or more characters
  hex     [0-9a-f]+ of 24 or more characters
Added spans come from linking. Weak parts are looked for in each scope: access identifiers (a named id such as `user=`,
`client_id:`, or an AKIA/ASIA key of any length from 8), secrets (bare tokens of 20 or more characters which mix at least
three of lower, upper, digit and symbol; or a base span) and endpoints (URLs with a scheme, host:port, and bare cloud
hosts). Scopes are intervals of SCOPE characters on both sides of each access identifier. An interval join (sorted starts,
binary search) finds the parts whose intervals meet a scope; a weak part is reported (kinds link_id, link_secret,
link_endpoint) only if the scope holds an identifier and a secret, and an endpoint only beside both. A part alone is never
reported, and base spans never disappear.

Work is per text and linear in its length (after sorting its matches; no pattern backtracks over a run): no shuffle, whole texts.
Edge cases: null or empty text: no span, the digest of the empty string. Repeated rows and null doc_ids keep their rows;
ties of a start are ordered by kind as listed; an empty table gives an empty result. Extra columns pass through, but those
named like a result column give way to it in `scan`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.common import append_columns, map_text

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINT = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)

WEAK_ID = re.compile(r"""\b(?i:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})|\b(?:AKIA|ASIA)[A-Z0-9]{4,}""", re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+")
#: A run of host characters, and a port behind it. Runs are taken whole, so a long dotted run is read once.
HOST = re.compile(r"([a-z0-9.-]++)(:[0-9]{2,5}+\b)?", re.ASCII)
#: Ends of the host names of cloud services.
CLOUDS = (".amazonaws.com", ".windows.net", ".googleapis.com")
KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
SCOPE = 200


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if HINT.search(text):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def _mixed(token: str) -> bool:
    kinds = [any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token), any(c in "+/_=-" for c in token)]
    return kinds[2] and sum(kinds) >= 3


def endpoints(text: str) -> list[tuple[int, int]]:
    """Spans of URLs with a scheme and, outside of these, of dotted hosts with a port and of cloud hosts."""
    urls = [m.span() for m in URL.finditer(text)] if "://" in text else []
    out, at = list(urls), 0
    if ":" not in text and not any(c in text for c in CLOUDS):
        return out
    for m in HOST.finditer(text):
        run = m[1]
        if "." not in run:
            continue
        while at < len(urls) and urls[at][1] <= m.start():
            at += 1
        if at < len(urls) and urls[at][0] < m.end():
            continue
        if m[2]:
            name = run[run.rfind("..") + 2 if ".." in run else 0 :].lstrip(".-")
            if "." in name and not name.endswith("."):
                out.append((m.end(1) - len(name), m.end()))
                continue
        stop = max(run.rfind(c) + len(c) if c in run else 0 for c in CLOUDS)
        after = text[m.start() + stop : m.start() + stop + 1]
        if stop and not (after.isalnum() or after == "_"):
            name = run[:stop].lstrip(".-")
            if name.count(".") > 1:
                out.append((m.start() + stop - len(name), m.start() + stop))
    return sorted(out)


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """The weak parts that complement each other within a scope."""
    ids = [m.span() for m in WEAK_ID.finditer(text)] if ("=" in text or ":" in text or "AKIA" in text or "ASIA" in text) else []
    strong_ids = {(s, e) for s, e, k in base if k == "access"}
    anchors = {*ids, *strong_ids}
    if not anchors:
        return []
    found = set()
    weak = _Intervals([m.span() for m in WEAK_SECRET.finditer(text) if _mixed(m[0]) and m.span() not in anchors])
    strong = [_Intervals([(s, e) for s, e, k in base if k == kind]) for kind in ("assign", "hex")]
    ends = _Intervals(endpoints(text))
    for s, e in sorted(anchors):
        low, high = s - scope, e + scope
        near = [x for x in weak.meeting(low, high) if x[1] <= s or x[0] >= e]
        if not near and not any(x[1] <= s or x[0] >= e for kind in strong for x in kind.meeting(low, high)):
            continue
        if (s, e) not in strong_ids:
            found.add((s, e, "link_id"))
        found |= {(a, b, "link_secret") for a, b in near}
        found |= {(a, b, "link_endpoint") for a, b in ends.meeting(low, high)}
    return sorted(found - set(base))


class _Intervals:
    """Intervals of one kind, which never overlap, so that their ends are in the order of their starts: those that meet a range
    are neighbours."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.rows = sorted(rows)
        self.starts, self.ends = [r[0] for r in self.rows], [r[1] for r in self.rows]

    def meeting(self, low: int, high: int) -> list[tuple[int, int]]:
        return self.rows[bisect_left(self.ends, low) : bisect_right(self.starts, high)]


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def find(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base spans, all spans."""
    text = text or ""
    base = base_spans(text)
    count = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    return (*count, render(base), render(base + linked_spans(text, base)))


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_spans and spans."""
    fields = [("n_assign", pa.int64(), "bigint"), ("n_access", pa.int64(), "bigint"), ("n_hex", pa.int64(), "bigint"), ("base_spans", pa.string(), "string"), ("spans", pa.string(), "string")]
    return append_columns(docs, lambda texts: list(zip(*map(find, texts))) or [[]] * 5, fields)


def redact(text: str | None) -> str | None:
    """text with every span, of any kind, replaced by `[SECRET]`; overlapping spans become one."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted((s, e) for s, e, _ in base + linked_spans(text, base))
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the secrets of their texts replaced; every row and other column stays."""
    return map_text(docs, redact)


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
