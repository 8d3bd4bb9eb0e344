"""Secret scans by one combined deterministic automaton.

The detecting expressions of all rules are compiled into one automaton (subset construction, then minimisation) with
plain transition arrays; it reads every byte of a text once and tells which rules have a match in it. For these rules
alone, and only in such texts, the rule's own automaton gives the spans: leftmost, longest, without overlap. Spans
that fail the rule's length are dropped, and the search goes on after them.

The base kinds are ``assign``, ``access`` and ``hex``; the method adds the kinds of ``RULES`` after these. Offsets are
code points, ends exclusive. Texts are judged within their row: there is no shuffle.

Rules whose combined automaton would be too large are compiled into several, each of which reads the text once.

Defined cases: null is empty; an empty text has no spans; a very long text costs time in proportion, whatever it holds,
and some copies of itself as bytes; spans of one start are in the rules' order; repeated rows get a row each; null ids
stay null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, several


@dataclass(frozen=True)
class Rule:
    """``pattern`` gives the spans; they need ``least`` bytes after the longest match of ``head`` at their start.
    ``detect``, an expression that matches within any span that counts, goes into the combined automaton."""

    kind: str
    pattern: str
    least: int
    detect: str
    head: str = ""


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
_HEAD = _KEY + r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", _HEAD + _VALUE + "+", 8, _HEAD + _VALUE, _HEAD),
    Rule("access", "AKIA[A-Z0-9]+", 16, "AKIA[A-Z0-9]{12}"),
    Rule("hex", "[0-9a-f]+", 32, "[0-9a-f]{32}"),
)
#: What the method adds: prefixed tokens of well-known services, private key headers and signed web tokens.
ADDED = (
    Rule("git", "gh[pousr]_[A-Za-z0-9]+", 40, "gh[pousr]_"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15, "xox[abprs]-"),
    Rule("map", "AIza[A-Za-z0-9_-]+", 39, "AIza"),
    Rule("pay", "[rs]k_live_[A-Za-z0-9]+", 24, "[rs]k_live_"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 1, r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, r"\.eyJ"),
)
RULES = BASE + ADDED
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class _Own:
    """A rule's automaton, its head's, the bytes that may begin a span, and an automaton that finds all starts."""

    whole: Automaton
    head: Automaton | None
    begins: bytes
    backward: Automaton


@functools.cache
def compiled(rules: tuple[Rule, ...]) -> tuple[list[tuple[Automaton, int]], list[_Own]]:
    """The combined automaton, or several where one would be too large, and each rule's own."""
    own = []
    for r in rules:
        a = Automaton([r.pattern], False)
        may = bytes(a.next[a.start + a.classes[b]] != a.dead for b in range(256))
        own.append(_Own(a, Automaton([r.head], False) if r.head else None, may, Automaton([r.pattern], True, True)))
    return several([r.detect for r in rules]), own


def _own_spans(data: bytes, rule: Rule, own: _Own) -> Iterator[tuple[int, int]]:
    """Leftmost, longest spans. Where starts that lead to no match have cost as much as the text is long, one pass from
    the end marks the starts that do, so that time stays in proportion to the text."""
    classed, at, n = data.translate(own.whole.classes), 0, len(data)
    headed = data.translate(own.head.classes) if own.head else b""
    may, lost, marked = data.translate(own.begins), 0, False
    while (at := may.find(1, at)) >= 0:
        end, read = own.whole.longest(classed, at)
        if end <= at:
            at, lost = at + 1, lost + read
            if lost > n and not marked:
                may, marked = own.backward.starts(data.translate(own.backward.classes)), True
            continue
        if end - (own.head.longest(headed, at)[0] if own.head else at) >= rule.least:
            yield at, end
        at = end


def scan(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """Spans in UTF-8 ``data``, in code points, by start, then by the rules' order."""
    combined, own = compiled(rules)
    found = 0
    for a, first in combined:
        found |= a.seen(data) << first
    if not found:
        return []
    spans = [(s, i, e) for i, r in enumerate(rules) if found >> i & 1 for s, e in _own_spans(data, r, own[i])]
    if data.isascii():
        points = {x: x for s, _, e in spans for x in (s, e)}
    else:
        points, last, count = {}, 0, 0
        for x in sorted({x for s, _, e in spans for x in (s, e)}):
            count += len(data[last:x].decode())
            points[x], last = count, x
    return [(rules[i].kind, points[s], points[e]) for s, i, e in sorted(spans)]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its spans, as an array of kind, start and end."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t.as_py() or b"", rules)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def joined(spans, kinds: tuple[str, ...] | None = None):
    """A Column: the spans, of the kinds given, as kind:start:end with commas between."""
    spans = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else spans
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def digest(scanned: DataFrame) -> DataFrame:
    base = tuple(r.kind for r in BASE)
    counts = [F.size(F.filter("spans", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in base]  # noqa: B023
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("spans"), base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute(text: str | None) -> list[tuple[str, int, int]]:
    """The base kinds by Python's own expressions, for tests."""
    import re

    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    for i, (p, n) in enumerate((("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)), 1):
        out += [(m.start(), i, m.end()) for m in re.finditer(p, text or "") if m.end() - m.start() >= n]
    return [(BASE[i].kind, s, e) for s, i, e in sorted(out)]


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
