"""The text gate: is a text layer legible, or the garbage of a bad scan?"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, normalize_letters
from ..plans.options import Gate

#: A small dictionary of our own. Give ``words`` a fuller one for other languages or trades.
WORDS = (
    "and are all any been before below between but can contact contract customer date days delivery description due for from have "
    "information invoice item items letter month net note number office only order other our page payment period please price product "
    "quantity rate reference sales service shall subject tax terms than that the their them then there these this time total under unit "
    "value was week will with within without you your "
    "aber alle auch bank bei beleg betrag bitte brutto dann das datum dem den der des die diese doch durch ein eine einer firma gesamt "
    "gegen haben hier ihre ist kann kein konto kunde leistung lieferung menge mehr mit monat nach netto nicht noch nummer nur oder ohne "
    "position preis rechnung satz sein seite sich sie sind steuer summe ueber und unter vertrag vom von vor wenn werden wert wird wir "
    "zahlbar zahlung zeit zum zur zwischen"
).split()
LETTERS, LONG, PART = 4, 6, (4, 12)


def trie_expression(words: Sequence[str]) -> str:
    """An expression for any of the words that tries each first letter once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def show(node: dict) -> str:
        parts = [re.escape(c) + show(n) for c, n in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return body + ("?" if "" in node else "")

    return show(tree)


def text_gate(text: Column, options: Gate = Gate(), words: Sequence[str] = WORDS) -> Column:  # noqa: B008
    """verdict (ok or garbage), hit_rate (null below the least count of tokens), cid_tokens, replacement_ratio,
    single_ratio, considered and reasons. ``text`` is all lines joined. A token is a run of letters; it is a hit if it is a
    word of four letters or more, or has six or more with a word of 4 to 12 letters inside."""
    cid = F.regexp_count(text, F.lit(r"\(cid:[0-9]+\)"))
    replacement = F.when(F.length(text) > 0, F.regexp_count(text, F.lit("�")) / F.length(text)).otherwise(F.lit(0.0))
    inside = trie_expression([w for w in words if PART[0] <= len(w) <= PART[1]]) or "(?!)"
    whole = trie_expression([w for w in words if len(w) >= LETTERS]) or "(?!)"
    hit = rf"(?<!\p{{L}})(?:(?:{whole})(?!\p{{L}})|(?=\p{{L}}{{{LONG}}})\p{{L}}*?(?:{inside})\p{{L}}*+)"

    def counts(t: Column) -> Column:
        parts = {"n": r"\p{L}++", "single": r"(?<!\p{L})\p{L}(?!\p{L})", "considered": rf"\p{{L}}{{{LETTERS},}}+", "hits": hit}
        return F.struct(*[F.regexp_count(t, F.lit(x)).cast("long").alias(n) for n, x in parts.items()])

    counted = let(normalize_letters(text), counts)

    def of(c: Column) -> Column:
        single = F.when(c["n"] > 0, c["single"] / c["n"]).otherwise(F.lit(0.0))
        rate = F.when(c["considered"] >= options.least_tokens, c["hits"] / c["considered"])
        reasons = [
            F.when(cid > 0, F.concat(F.lit("cid_tokens="), cid.cast("string"))),
            F.when(replacement > options.most_replacement, F.concat(F.lit("replacement_ratio="), F.format_number(replacement, 3))),
            F.when((single > options.most_single) & (c["n"] >= options.least_tokens), F.concat(F.lit("single_char_ratio="), F.format_number(single, 2))),
            F.when(rate < options.least_hit_rate, F.concat(F.lit("dict_hit_rate="), F.format_number(rate, 2))),
        ]
        why = F.filter(F.array(*reasons), lambda r: r.isNotNull())
        return F.struct(
            F.when(F.size(why) > 0, "garbage").otherwise("ok").alias("verdict"),
            rate.alias("hit_rate"),
            cid.alias("cid_tokens"),
            replacement.alias("replacement_ratio"),
            single.alias("single_ratio"),
            c["considered"].alias("considered"),
            why.alias("reasons"),
        )

    return let(counted, of)
