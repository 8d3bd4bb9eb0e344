"""URL filters: pattern rules found through their rarest literal token, in Column expressions only.

Every rule is a regular expression over ``host/path?query`` with literal tokens (runs of letters and digits) that any
matching URL must contain as whole tokens. A rule is indexed under the one of them that the fewest rules hold, ties to
the longer and then to the lesser; a rule without any is indexed under the empty token, which every URL has. The index
is a table of token and rule. Distinct addresses are taken apart into their distinct tokens, these join the index, and
only the rules so fetched run their expressions: the work for a URL follows from its tokens, not from the number of
rules. An index of up to ``MOST_BYTES`` is broadcast; a larger one is joined by token.

Verdicts go back to the pages by address. An address that a third of all pages share is judged once, and its verdict is
sent to each salt of the pages that have it.

Host rules (a host with its subdomains, and the start of a path) are rules of the same index. Among matching host
rules the longest wins and overrules all patterns, of equal ones an allowing one. Else a matching exception pattern
allows, else a matching block pattern blocks, else the URL is allowed; of several patterns the one of the greatest name
is told.

Defined cases: a null URL, or one without ``://``, has an empty host and path, matches no rule and is allowed; so is
every URL where there are no rules; repeated rows and rows of one id or of null ids get a row each; a very long URL is
read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

MOST_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """``tokens``: literals of which each stands as a whole token in any URL that ``pattern`` matches."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    host: bool = False


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    pattern = rf"^(?:[^/?#]*\.)?\Q{host}\E\Q{path}\E"
    whole = re.findall(r"[a-z0-9]+", host)
    whole += [m[1] for m in re.finditer(r"(?<![A-Za-z0-9])([a-z0-9]+)(?=[^A-Za-z0-9])", path)]
    return Rule(host + path, pattern, tuple(whole), verdict, True)


def pattern_rule(verdict: str, text: str) -> Rule:
    """An expression in the manner of ad blockers: ``||`` anchors at a host or subdomain, ``^`` is a separator or the
    end, ``*`` is anything. Tokens cut off by ``*`` or by an open end are not whole and not used."""
    body, anchored = (text[2:], True) if text.startswith("||") else (text, False)
    parts = [{"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(x, rf"\Q{x}\E") for x in re.findall(r"[*^]|[^*^]+", body)]
    padded = ("^" if anchored else "*") + body + "*"
    whole = [m[0].lower() for m in re.finditer(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", padded)]
    return Rule(text, (r"^(?:[^/?#]*\.)?" if anchored else "") + "(?i:" + "".join(parts) + ")", tuple(whole), verdict)


#: The rules of op4: host rules as given, then patterns for pages of spam and for addresses that only track.
HOST_RULES = (host_rule("block", "net"), host_rule("allow", "example.net", "/en/"), host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/"))
PATTERN_RULES = tuple(
    pattern_rule(*x)
    for x in (
        ("block", "cheap-pills."),
        ("block", "free-bets."),
        ("block", "adult-x."),
        ("block", "||casino."),
        ("block", "||ads."),
        ("block", "/login^"),
        ("block", "/cart^"),
        ("block", "/wp-admin^"),
        ("block", "?replytocom="),
        ("block", "&sessionid="),
        ("allow", "||docs.*/casino^"),
    )
)


def index(rules: tuple[Rule, ...]) -> list[tuple[str, Rule]]:
    """Each rule with its rarest literal token, or the empty one."""
    held: dict[str, int] = {}
    for r in rules:
        for t in set(r.tokens):
            held[t] = held.get(t, 0) + 1
    return [(min(r.tokens, key=lambda t: (held[t], -len(t), t)) if r.tokens else "", r) for r in rules]


def index_table(spark: SparkSession, rules: tuple[Rule, ...], most_bytes: int = MOST_BYTES) -> DataFrame:
    """token, and rule: whether for a host, length, verdict, name, pattern. Broadcast if it is small."""
    rows = [{"token": t, "rule": {"host": r.host, "length": len(r.name) if r.host else 0, "verdict": r.verdict, "name": r.name, "pattern": r.pattern}} for t, r in index(rules)]
    parts = [json.dumps(rows[a : a + 10_000], ensure_ascii=False) for a in range(0, len(rows), 10_000)] or ["[]"]
    kind = "array<struct<token:string,rule:struct<host:boolean,length:int,verdict:string,name:string,pattern:string>>>"
    body = F.explode(F.array(*map(F.lit, parts)))
    table = spark.range(1).select(body.alias("part")).select(F.inline(F.from_json("part", kind)))
    return F.broadcast(table) if sum(map(len, parts)) <= most_bytes else scratch.table(table, "url-rules")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``,
    ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the deciding pattern's text, or null) and n_run, the number of
    expressions that ran on the URL."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host, path = host_and_path(url)
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)://[^/?#]*(.*)", 1)).otherwise(F.lit(""))
    page = F.col(f"`{id_col}`")
    salt = F.pmod(F.xxhash64(page.cast("string"), url), F.lit(scratch.SALTS)).cast("int")
    t = pages.select(page.alias("page_id"), host.alias("host"), path.alias("path"), F.concat(host, after).alias("at"), salt.alias("salt"))
    asked = t.where("host <> ''").groupBy("at").agg(scratch.salts(F.col("salt")))
    tokens = F.array_distinct(F.concat(F.split(F.lower("at"), "[^a-z0-9]+"), F.array(F.lit(""))))
    fetched = asked.select("at", "salts", F.explode(tokens).alias("token")).join(index_table(pages.sparkSession, rules, most_bytes), "token")
    fit = F.rlike("at", F.col("rule.pattern"))
    allows = F.col("rule.verdict") == "allow"

    def most(of: Column) -> Column:
        return F.max(F.when(of, F.struct("rule.length", "rule.verdict", "rule.name")))

    by_host = F.max(F.when(fit & F.col("rule.host"), F.struct("rule.length", allows.alias("allows"), "rule.verdict", "rule.name")))
    found = fetched.groupBy("at", "salts").agg(
        by_host.alias("by_host"), most(fit & ~F.col("rule.host") & allows).alias("allowing"), most(fit & ~F.col("rule.host") & ~allows).alias("blocking"), F.count("*").cast("int").alias("n_run")
    )
    found = found.withColumn("by_pattern", F.coalesce("allowing", "blocking")).select("at", "by_host", "by_pattern", "n_run", scratch.each_salt())
    return t.join(found, ["at", "salt"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("by_host")["name"].alias("rule"),
        F.coalesce(F.col("by_host")["verdict"], F.col("by_pattern")["verdict"], F.lit("allow")).alias("verdict"),
        F.when(F.col("by_host").isNull(), F.col("by_pattern")["name"]).alias("pattern"),
        F.coalesce("n_run", F.lit(0)).alias("n_run"),
    )


def oracle(rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES) -> str:
    """The same verdicts as SQL that tries every rule on every URL."""
    def fits(r: Rule) -> str:
        return "regexp_matches(addr, '" + r.pattern.replace("'", "''") + "')"

    hosts = sorted((r for r in rules if r.host), key=lambda r: (-len(r.name), r.verdict, r.name))
    name = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in hosts)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in hosts)
    kinds = {v: " OR ".join(fits(r) for r in rules if not r.host and r.verdict == v) or "false" for v in ("allow", "block")}
    return f"""WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*(.*)', 1) AS tail FROM u),
t AS (SELECT page_id, host, path, host || tail AS addr FROM h)
SELECT page_id, host, path, CASE WHEN host = '' THEN NULL {name} END AS rule,
 CASE WHEN host = '' THEN 'allow' {verdict} WHEN {kinds["allow"]} THEN 'allow' WHEN {kinds["block"]} THEN 'block' ELSE 'allow' END AS verdict FROM t"""
