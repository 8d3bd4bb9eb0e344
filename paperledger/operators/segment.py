"""Pages into segments, before classification: several invoices in one file, and attachments behind an invoice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalize_label, spaced, trim

#: Strong signs of an attachment, a page counter, a new invoice and a block of totals.
ATTACHMENT = spaced(r"(?i:allgemeine\s+gesch[aäÄ]ftsbedingungen)|(?<![A-Za-z0-9_])AGB(?![A-Za-z0-9_])|(?i:terms\s+(and|&)\s+conditions)|(?i:widerrufsbelehrung)")
COUNTER = spaced(r"(?i)seite\s+([0-9]+)\s+von\s+([0-9]+)|page\s+([0-9]+)\s+of\s+([0-9]+)")
INVOICE = spaced(r"(?i)^(rechnung|invoice|gutschrift|credit\s?note)(?![A-Za-z0-9_])")
TOTALS = r"gesamtbetrag|rechnungsbetrag|endbetrag|total|zuzahlen|zahlbetrag"
TOP = 0.3
SEGMENT = "array<struct<pages:array<int>,kind:string>>"


def page_features(lines: Column, page_count: Column) -> Column:
    """For each page: page, attachment, restart (its counter says 1), invoice (a heading on top), totals."""
    def of(p: Column) -> Column:
        own = F.filter(lines, lambda x: x["page"] == p)
        top = F.filter(own, lambda x: x["box"]["y0"] < TOP)
        text = F.array_join(F.transform(own, lambda x: x["text"]), "\n")
        count = F.coalesce(F.nullif(F.regexp_extract(text, COUNTER, 1), F.lit("")), F.nullif(F.regexp_extract(text, COUNTER, 3), F.lit("")))
        return F.struct(
            p.alias("page"),
            F.exists(top, lambda x: x["text"].rlike(ATTACHMENT)).alias("attachment"),
            F.coalesce((p > 1) & (count.try_cast("int") == 1), F.lit(False)).alias("restart"),
            F.exists(top, lambda x: trim(x["text"]).rlike(INVOICE)).alias("invoice"),
            F.exists(own, lambda x: normalize_label(x["text"]).rlike(TOTALS) & x["text"].rlike("[0-9]")).alias("totals"),
        )

    return F.when(page_count > 0, F.transform(F.sequence(F.lit(1), F.greatest(page_count, F.lit(1))), of)).otherwise(F.array().cast("array<struct<page:int,attachment:boolean,restart:boolean,invoice:boolean,totals:boolean>>"))


def segments(pages: Column) -> Column:
    """A fold over the pages' features in order. An attachment ends a segment and so does its end; a new invoice starts
    one where the counter restarts, or under a heading once the segment has shown totals. Never empty."""
    start = F.struct(F.array().cast(SEGMENT).alias("done"), F.lit(False).alias("saw"))

    def step(a: Column, p: Column) -> Column:
        last = F.try_element_at(a["done"], F.lit(-1))
        attached = F.coalesce(last["kind"] == "attachment", F.lit(False))
        fresh = ~attached & ~p["attachment"] & (p["restart"] | (p["invoice"] & a["saw"]))
        new = (F.size(a["done"]) == 0) | (p["attachment"] != attached) | fresh
        kind = F.when(p["attachment"], F.lit("attachment")).otherwise(F.lit("invoice-candidate"))
        opened = F.concat(a["done"], F.array(F.struct(F.array(p["page"]).alias("pages"), kind.alias("kind"))))
        grown = F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(F.struct(F.concat(last["pages"], F.array(p["page"])).alias("pages"), last["kind"].alias("kind"))))
        return F.struct(F.when(new, opened).otherwise(grown).alias("done"), ((~new & a["saw"]) | p["totals"]).alias("saw"))

    found = F.aggregate(pages, start, step)["done"]
    none = F.array(F.struct(F.array().cast("array<int>").alias("pages"), F.lit("invoice-candidate").alias("kind")))
    return F.when(F.size(found) > 0, found).otherwise(none)


def slice_lines(lines: Column, pages: Column) -> Column:
    """The lines of these pages, with pages numbered anew; a token of a page that is not among them gets page 1."""
    def token(t: Column) -> Column:
        at = F.array_position(pages, t["page"]).cast("int")
        return t.withField("page", F.when(at > 0, at).otherwise(F.lit(1)))

    kept = F.filter(lines, lambda x: F.array_contains(pages, x["page"]))
    return F.transform(kept, lambda x: x.withField("page", F.array_position(pages, x["page"]).cast("int")).withField("tokens", F.transform(x["tokens"], token)))


def slice_tables(tables: Column, pages: Column) -> Column:
    return F.transform(F.filter(tables, lambda t: F.array_contains(pages, t["page"])), lambda t: t.withField("page", F.array_position(pages, t["page"]).cast("int")))
