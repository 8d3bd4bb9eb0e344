"""Personal data by weak supervision, in DataFrame operations only.

1. *Candidates.* Expressions find spans of the base kinds (email, ip, card, phone; those that fail their check are
   dropped) and of weaker kinds (spelled-out addresses, local phone numbers, account numbers, social security numbers)
   that no base span overlaps.
2. *Labelers.* A stricter expression or checksum, a gazetteer, the words before, the signs around, and the look of a
   placeholder each vote for, against or not at all on every candidate.
3. *Expectation-maximisation* over the counts of kinds and votes estimates each labeler's reliability and the chance
   of every pattern of votes to be personal data. There are at most 3 ** labelers patterns for each kind, so these
   counts have a fixed bound whatever the number of documents, and the driver computes on them.
4. *Span classifier.* It sees a span and its context, not the votes: the kind, the length, the shape, the words before
   and after and the signs around, each hashed to one of ``FEATURES`` numbers. Trained on the estimated chances of all
   candidates, it is a naive Bayes model with soft labels, whose counts come from one aggregation of bounded size. It
   decides on the weaker kinds' candidates, within their rows. Base spans stay.

A document's candidates are found once and kept in the shared folder, without its text; nothing is shuffled but the
counts. Positions are code points, ends exclusive: they follow from the lengths of what an expression matches and of
what lies between the matches, summed by blocks of ``STEP`` matches.

Defined cases: null is empty; an empty text has no spans; repeated rows get a row each; null ids stay null; spans of
different base kinds may overlap, and each stays; without any candidate the model accepts none; an empty table gives an
empty result; other columns are not read. A very long text is split once for each expression; the expressions never
give back what they took, so that long runs of digits or letters cost time in proportion, and so do many matches but
for one addition in ``STEP`` of their square.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

BASE = ("email", "ip", "card", "phone")
WEAK = ("spelled", "local", "iban", "ssn")
KINDS = BASE + WEAK
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[a-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[a-z0-9-]++)++",
    "local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A quick look at a text: without a match of this, it holds no candidate of the kind.
QUICK = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9][\x20().0-9-]{7}"}
QUICK_WEAK = r"(?i)\[at\]|\(at\)|[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}\x20?[A-Z0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Gazetteers: ends of mail domains, dialling codes, issuers of cards, countries of account numbers.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|at|ch|eu|uk|us|pl|se|pt|br|jp|cn|in|ru)$",
    "spelled": r"(?i)(\.|\[dot\]|\(dot\))\x20?(com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|at|ch|eu|uk|us|pl|se|pt|br|jp|cn|in|ru)$",
    "phone": r"^\+(1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|61|81|82|86|90|91)(?![0-9]{14})",
    "local": r"^\(?[2-9][0-9]{2}",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "iban": r"^(AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "ip": r"^(?!0*(0|10|127|255)\.|0*192\.0*168\.|0*169\.0*254\.)",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
STRICT = {
    "email": r"(?i)^[a-z0-9][a-z0-9._%+-]*+@(?:[a-z0-9-]++\.)++[a-z]{2,24}$",
    "ip": rf"^{OCTET}(\.{OCTET}){{3}}$",
    "phone": r"^\+[1-9]",
    "spelled": r"(?i)[a-z]{2,24}$",
    "local": r"^(\([0-9]{3}\)\x20|[0-9]{3}[.-])[2-9][0-9]{2}[.-][0-9]{4}$",
    "ssn": r"^[0-8]",
}
WORDS_FOR = {
    "email": r"(?i)(e-?mail|contact|write|correo|courriel|kontakt|@)",
    "spelled": r"(?i)(e-?mail|contact|write|correo|courriel|kontakt)",
    "ip": r"(?i)\b(ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|karte|carte|tarjeta|cvv)\b",
    "phone": r"(?i)\b(phone|tel|call|fax|mobile|cell|telefon|t[eé]l[eé]fono?)\b",
    "local": r"(?i)\b(phone|tel|call|fax|mobile|cell|telefon|t[eé]l[eé]fono?)\b",
    "iban": r"(?i)\b(iban|account|konto|compte|cuenta|bank)\b",
    "ssn": r"(?i)\b(ssn|social|security)\b",
}
WORDS_AGAINST = r"(?i)\b(version|release|isbn|order|invoice|figure|page|part|serial|sku|commit|ticket)\b\W*$"
PLACEHOLDER = r"(?i)^(.)\1+$|^0+$|123-?45-?6789|(?:example|test|foo)@|^(?:name|user|someone)\b|x{3,}"
LABELERS = ("strict", "gazetteer", "before", "around", "placeholder")
GROUPS = ("length", "shape", "last", "second", "next", "signs")
CONTEXT = 40
EM_ROUNDS = 60
STEP = 64
FEATURES = 1 << 14
#: Values that a feature of a group may take, about: the spread of its smoothing.
SPREAD = 512
SMOOTH = 0.5
SPAN = "struct<start:bigint,end:bigint,found:string,before:string,after:string>"


def _bound(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def matches(text: Column, pattern: str) -> Column:
    """start, end and text of each match, leftmost and without overlap, and ``CONTEXT`` signs before and after it at
    most: what lies between it and the next match, and of that match. The text is split once."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def sized(x: Column) -> Column:
        steps = F.transform(x["found"], lambda m, i: (F.length(m) + F.length(F.get(x["between"], i))).cast("long"))
        return F.struct(x["found"].alias("found"), x["between"].alias("between"), steps.alias("steps"))

    def blocked(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(x["steps"]) - 1) / STEP).cast("int"))
        sums = F.transform(blocks, lambda k: _sum(F.slice(x["steps"], k * STEP + 1, F.lit(STEP))))
        return F.struct(x["found"].alias("found"), x["between"].alias("between"), x["steps"].alias("steps"), sums.alias("sums"))

    def begun(x: Column) -> Column:
        begins = F.transform(x["sums"], lambda _, k: _sum(F.slice(x["sums"], F.lit(1), k)))
        return F.struct(x["found"].alias("found"), x["between"].alias("between"), x["steps"].alias("steps"), begins.alias("begins"))

    def spans(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / STEP).cast("int")
            end = F.get(x["begins"], block) + _sum(F.slice(x["steps"], block * STEP + 1, i - block * STEP + 1))
            before = F.right(F.concat(F.coalesce(F.get(x["found"], i - 1), F.lit("")), F.get(x["between"], i)), F.lit(CONTEXT))
            after = F.left(F.concat(F.get(x["between"], i + 1), F.coalesce(F.get(x["found"], i + 1), F.lit(""))), F.lit(CONTEXT))
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found"), before.alias("before"), after.alias("after"))

        return F.transform(x["found"], one)

    def placed(x: Column) -> Column:
        return _bound(_bound(_bound(x, sized), blocked), lambda y: _bound(begun(y), spans))

    none = F.array().cast(f"array<{SPAN}>")
    return _bound(parts, lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(none))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod_97(found: Column) -> Column:
    """Whether an account number's check digits hold."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("^[0-9]$"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + letter) % 97

    return F.aggregate(turned, F.lit(0), step) == 1


def _checked(kind: str, spans: Column) -> Column:
    if kind == "ip":
        return F.filter(spans, lambda s: F.rlike(s["found"], F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")))
    if kind == "card":
        return F.filter(spans, lambda s: F.when(F.length(_digits(s["found"])).between(13, 19), luhn(_digits(s["found"]))).otherwise(F.lit(False)))
    if kind == "phone":
        return F.filter(spans, lambda s: F.length(_digits(s["found"])).between(9, 15))
    return spans


def _vote(yes: Column, no: Column | None = None) -> Column:
    no = ~yes if no is None else no
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _near(span: Column) -> Column:
    """The signs on both sides."""
    return F.concat(F.right(span["before"], F.lit(1)), F.left(span["after"], F.lit(1)))


def _votes(kind: str, span: Column) -> list[Column]:
    found, before = span["found"], span["before"]
    near = _near(span)
    strict = _vote(F.lit(True)) if kind == "card" else _vote(mod_97(found)) if kind == "iban" else _vote(found.rlike(STRICT[kind]))
    known = found.rlike(GAZETTEER[kind])
    return [
        strict,
        _vote(known, F.lit(False) if kind in ("phone", "card") else ~known),
        _vote(before.rlike(WORDS_FOR[kind]), before.rlike(WORDS_AGAINST)),
        _vote(~near.rlike("[A-Za-z0-9_]"), near.rlike("[A-Za-z0-9_]")),
        _vote(F.lit(False), found.rlike(PLACEHOLDER)),
    ]


def _shape(found: Column) -> Column:
    """Signs with letters as a and digits as 9, runs of more than four as five."""
    plain = F.regexp_replace(F.regexp_replace(found, r"\p{L}", "a"), "[0-9]", "9")
    return F.regexp_replace(plain, r"(.)\1{4,}", "$1$1$1$1$1")


def _features(kind: str, span: Column) -> Column:
    """Numbers of the span's features, one for each of ``GROUPS``."""
    values = {
        "length": F.floor(F.log2(F.length(span["found"]) + F.lit(1)) * 2).cast("string"),
        "shape": _shape(span["found"]),
        "last": F.lower(F.regexp_extract(span["before"], r"(\p{L}+)\P{L}*$", 1)),
        "second": F.lower(F.regexp_extract(span["before"], r"(\p{L}+)\P{L}+\p{L}+\P{L}*$", 1)),
        "next": F.lower(F.regexp_extract(span["after"], r"^\P{L}*(\p{L}+)", 1)),
        "signs": _shape(_near(span)),
    }
    return F.array(*[F.pmod(F.xxhash64(F.lit(f"{kind} {g}"), values[g]), F.lit(FEATURES)).cast("int") for g in GROUPS])


def _apart(spans: Column, base: Column, length: Column) -> Column:
    """Those spans that no base span overlaps. A text of many base spans is taken in a hundred stretches, so that a span
    is held only against those that reach into its own two."""
    def meets(s: Column, b: Column) -> Column:
        return (b["start"] < s["end"]) & (s["start"] < b["end"])

    def few(x: Column) -> Column:
        return F.filter(x["spans"], lambda s: ~F.exists(x["base"], lambda b: meets(s, b)))

    def many(x: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: F.filter(x["base"], lambda b: (b["start"] < (k + 1) * x["wide"]) & (b["end"] > k * x["wide"])))

        def free(y: Column) -> Column:
            def within(s: Column, at: Column) -> Column:
                return F.exists(F.get(y["each"], F.floor(at / y["wide"]).cast("int")), lambda b: meets(s, b))

            inner = lambda s: F.filter(y["base"], lambda b: meets(s, b))
            return F.filter(y["spans"], lambda s: F.when(s["end"] - s["start"] > y["wide"], F.size(inner(s)) == 0).otherwise(~within(s, s["start"]) & ~within(s, s["end"] - 1)))

        return _bound(F.struct(x["spans"].alias("spans"), x["base"].alias("base"), x["wide"].alias("wide"), each.alias("each")), free)

    wide = F.floor(length / 100) + 1
    return _bound(F.struct(spans.alias("spans"), base.alias("base"), wide.alias("wide")), lambda x: F.when((F.size(x["base"]) < 200) | (F.size(x["spans"]) < 200), few(x)).otherwise(many(x)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: kind, start, end, votes, features; base kinds first, in the order of KINDS, then by start."""
    text = F.col("text")
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    none = F.array().cast(f"array<{SPAN}>")
    may = {k: text.rlike(QUICK[k]) for k in QUICK} | {"email": F.instr(text, "@") > 0}
    t = t.withColumns({k: F.when(may[k], _checked(k, matches(text, PATTERNS[k]))).otherwise(none) for k in BASE})
    weak = text.rlike(QUICK_WEAK)
    t = t.withColumn("_weak", weak)
    t = t.withColumns({k: F.when(F.col("_weak"), _apart(matches(text, PATTERNS[k]), F.concat(*BASE), F.length(text))).otherwise(none) for k in WEAK})

    def voted(kind: str) -> Column:
        def one(s: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*_votes(kind, s)).alias("votes"), _features(kind, s).alias("features"))

        return F.transform(kind, one)

    return t.select("doc_id", F.concat(*map(voted, KINDS)).alias("spans"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], list[dict[bool, dict[int, float]]], list[float]]:
    """From counts of kinds and votes: each kind's share of personal data, each labeler's chance of a vote where the
    span is personal data and where not, and each pattern's chance. Starts from the majority."""
    def start(votes: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-float(sum(votes))))

    chance = [start(v) for _, v, _ in patterns]
    prior: dict[str, float] = {}
    says: list[dict[bool, dict[int, float]]] = []
    for _ in range(rounds):
        prior = {}
        for kind in {k for k, _, _ in patterns}:
            own = [(c, n) for (k, _, n), c in zip(patterns, chance, strict=True) if k == kind]
            prior[kind] = (1 + sum(c * n for c, n in own)) / (2 + sum(n for _, n in own))
        says = []
        for i in range(len(patterns[0][1]) if patterns else 0):
            table = {z: dict.fromkeys((-1, 0, 1), 1.0) for z in (True, False)}
            for (_, v, n), c in zip(patterns, chance, strict=True):
                table[True][v[i]] += c * n
                table[False][v[i]] += (1 - c) * n
            says.append({z: {a: x / sum(t.values()) for a, x in t.items()} for z, t in table.items()})
        last, chance = chance, []
        for k, v, _ in patterns:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(s[True][a] / s[False][a]) for s, a in zip(says, v, strict=True))
            chance.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max((abs(a - b) for a, b in zip(last, chance, strict=True)), default=0.0) < 1e-9:
            break
    return prior, says, chance


def chances(counts: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, str], float]:
    """The estimated chance of each kind and pattern of votes, the latter as a text."""
    return {(k, _named(v)): c for (k, v, _), c in zip(counts, estimate(counts)[2], strict=True)}


def _named(votes: tuple[int, ...]) -> str:
    return ",".join(map(str, votes))


def weights(sums: list[tuple[int, int, float, float]], totals: dict[str, tuple[float, float]]) -> tuple[list[float], dict[str, float]]:
    """The span classifier: each feature's log odds, and each kind's. ``sums``: feature, number of the kind, and its
    chances and those against summed; ``totals``: the same of each kind."""
    out = [0.0] * FEATURES
    for feature, kind, yes, no in sums:
        all_yes, all_no = totals[KINDS[kind]]
        out[feature] = math.log((yes + SMOOTH) / (all_yes + SMOOTH * SPREAD)) - math.log((no + SMOOTH) / (all_no + SMOOTH * SPREAD))
    return out, {k: math.log((y + SMOOTH) / (n + SMOOTH)) for k, (y, n) in totals.items()}


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a constant of the plan."""
    names = [x.split()[0] for x in schema.split(", ")]
    body = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ",".join(":".join(x.split()) for x in schema.split(", ")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(body), kind)))


def _trained(found: DataFrame) -> tuple[list[float], dict[str, float]]:
    votes = F.concat_ws(",", F.transform("s.votes", lambda v: v.cast("string")))
    each = found.select(F.explode("spans").alias("s")).select(F.col("s.kind").alias("kind"), votes.alias("votes"), F.col("s.features").alias("features"))
    rows = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    counts = sorted((r.kind, tuple(map(int, r.votes.split(","))), r.n) for r in rows)
    said = chances(counts)
    totals = {k: (sum(said[k, _named(v)] * n for j, v, n in counts if j == k), sum((1 - said[k, _named(v)]) * n for j, v, n in counts if j == k)) for k in {k for k, _, _ in counts}}
    if not counts:
        return [0.0] * FEATURES, {}
    table = _table(found.sparkSession, [(k, v, c) for (k, v), c in sorted(said.items())], "kind string, votes string, chance double")
    # At most 3 ** 5 patterns of votes for each of eight kinds.
    labelled = each.join(F.broadcast(table), ["kind", "votes"]).select("kind", "chance", F.explode("features").alias("feature"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    sums = labelled.groupBy("feature").agg(F.max(number).alias("kind"), F.sum("chance").alias("yes"), F.sum(1 - F.col("chance")).alias("no"))
    return weights(sorted((r.feature, int(r.kind), r.yes, r.no) for r in sums.collect()), totals)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans (kind, start, end), base kinds first in their order, then by start."""
    found = scratch.table(candidates(docs, id_col, text_col), "spans")
    by_feature, by_kind = _trained(found)
    own = F.from_json(F.lit(json.dumps([round(x, 9) for x in by_feature])), "array<double>")
    prior = F.coalesce(F.from_json(F.lit(json.dumps(by_kind)), "map<string,double>"), F.create_map().cast("map<string,double>"))

    def margin(s: Column) -> Column:
        start = F.coalesce(F.element_at(prior, s["kind"]), F.lit(-1.0))
        return F.round(F.aggregate(s["features"], start, lambda a, f: a + F.get(own, f)), 6)

    kept = F.filter("spans", lambda s: s["kind"].isin(*BASE) | (margin(s) >= 0))
    return found.select("doc_id", F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
