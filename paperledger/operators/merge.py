"""Two envelopes into one: the primary wins for each field, and for lists as a whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_invoices(p: Column, s: Column) -> Column:
    """Candidate invoices, each a struct or null. Totals and seller merge field by field; the buyer and the lists are
    taken whole, the primary's unless it has none."""
    def pick(name: str) -> Column:
        return F.coalesce(p[name], s[name]).alias(name)

    def whole(name: str) -> Column:
        return F.when(F.size(p[name]) > 0, p[name]).otherwise(s[name]).alias(name)

    def parts(name: str, fields: tuple[str, ...], *more: Column) -> Column:
        own = F.struct(*[F.coalesce(p[name][f], s[name][f]).alias(f) for f in fields], *more)
        return F.when(p[name].isNotNull() | s[name].isNotNull(), own).alias(name)

    ibans = F.when(F.size(p["seller"]["ibans"]) > 0, p["seller"]["ibans"]).otherwise(F.coalesce(s["seller"]["ibans"], F.array().cast("array<string>")))
    address = F.coalesce(p["seller"]["address"], s["seller"]["address"])
    return F.struct(
        *map(pick, ("invoice_number", "issue_date", "due_date", "currency", "locale")),
        parts("seller", ("name", "vat_id", "tax_number"), ibans.alias("ibans"), address.alias("address")),
        pick("buyer"),
        parts("totals", ("net", "tax", "gross")),
        whole("vat_breakdown"),
        whole("line_items"),
        pick("payment_terms"),
    )


def merge_meta(p: Column, s: Column) -> Column:
    """Provenance by path, the primary's where both have one. Rows that went with a list keep their entries."""
    return F.map_zip_with(p, s, lambda _, a, b: F.coalesce(a, b))


def least_confidence(meta: Column) -> Column:
    return F.array_min(F.transform(F.map_values(meta), lambda m: m["confidence"]))
