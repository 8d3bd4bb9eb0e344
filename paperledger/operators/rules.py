"""Header fields and line items by general labels, without a template."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.dates import parse_date
from ..functions.text import fold, label_end, label_expression, let, normalize_label, plain_label, remainder, spaced, trim
from ..plans.schemas import BOX
from .line_items import COLUMNS, NO_NUMBER, line_items

#: The labels of header fields, the expression of their values, and the headings of columns.
_DATE = spaced(r"[0-9]{1,4}[./-]\s?[0-9]{1,2}[./-]\s?[0-9]{1,4}")
_NUMBER = r"[A-Za-z0-9][A-Za-z0-9\-/._]{0,30}[0-9][0-9A-Za-z\-/._]*"
HEADER = {
    "invoice_number": (("Rechnungsnummer", "Rechnungs-Nr", "Rechnung Nr", "Rechnungsnr", "RE-Nr", "Re.-Nr", "Beleg-Nr", "Belegnummer", "Invoice No", "Invoice Number", "Invoice #", "Rechnung"), _NUMBER),
    "issue_date": (("Rechnungsdatum", "Belegdatum", "Datum", "Ausstellungsdatum", "Invoice Date", "Date of Issue", "Date"), _DATE),
    "due_date": (("Fällig am", "Fälligkeitsdatum", "Zahlbar bis", "Due Date", "Payment due"), _DATE),
    "net": (("Zwischensumme (netto)", "Zwischensumme", "Nettobetrag", "Summe netto", "Netto", "Warenwert", "Subtotal", "Net Amount", "Net Total"), ""),
    "tax": (("MwSt", "Mehrwertsteuer", "USt", "Umsatzsteuer", "zzgl. MwSt", "VAT", "Tax", "Sales Tax"), ""),
    "gross": (("Gesamtbetrag", "Rechnungsbetrag", "Endbetrag", "Zu zahlender Betrag", "Zahlbetrag", "Bruttobetrag", "Summe brutto", "Gesamt", "Total", "Total Due", "Amount Due", "Grand Total"), ""),
}
TABLE = {
    "position": ("Pos", "Pos.", "Position", "Nr", "#", "Item"),
    "description": ("Bezeichnung", "Beschreibung", "Artikel", "Leistung", "Posten", "Description", "Item Description", "Product"),
    "quantity": ("Menge", "Anzahl", "Stück", "Stk", "Qty", "Quantity", "Units"),
    "unit": ("Einheit", "ME", "Unit", "UoM"),
    "unit_price": ("Einzelpreis", "E-Preis", "Preis", "Stückpreis", "Satz", "Unit Price", "Price", "Rate"),
    "tax_rate": ("MwSt", "USt", "MwSt.-Satz", "St.-Satz", "Steuersatz", "VAT", "Tax Rate", "Tax %"),
    "line_total": ("Gesamt", "Betrag", "Gesamtpreis", "Summe", "Wert", "Amount", "Total", "Line Total"),
}
VAT_LINE = spaced(r"(?i)(mwst|mehrwertsteuer|ust|umsatzsteuer|vat|tax)[^%0-9]{0,20}([0-9]{1,2})\s?%\s*:?\s*(-?[0-9.,]+)")
HEADER_CONFIDENCE, ROW_CONFIDENCE = 0.65, 0.6
HIT = f"struct<value:string,raw:string,page:int,box:{BOX}>"


@dataclass(frozen=True)
class Lexicon:
    header: dict[str, tuple[tuple[str, ...], str]]
    table: dict[str, tuple[str, ...]]


DEFAULT = Lexicon(HEADER, TABLE)


def amount_value(rest: Column) -> Column:
    """raw and value of the last amount of a text that leads with a number; null where it does not, or where the last
    is not an amount."""
    last = F.try_element_at(F.regexp_extract_all(rest, F.lit(r"-?[0-9.,]+"), F.lit(0)), F.lit(-1))
    found = let(last, lambda x: F.struct(x.alias("raw"), parse_amount(x).alias("value")))
    return F.when(rest.rlike(spaced(r"^[€$£]?\s*-?[0-9]")), let(found, lambda x: F.when(x["value"].isNotNull(), x)))


def _field_value(field: str, pattern: str, rest: Column) -> Column:
    if field in ("net", "tax", "gross"):
        return amount_value(rest)
    raw = F.regexp_extract(rest, pattern, 0) if pattern else rest
    value = parse_date(raw) if field.endswith("_date") else trim(raw)
    return F.when((raw != "") & value.isNotNull(), F.struct(raw.alias("raw"), value.alias("value")))


def _folded(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(x["text"].alias("text"), fold(x["text"]).alias("folded"), x["page"].alias("page"), x["box"].alias("box"), F.lit(0).alias("end")))


def _hits(folded: Column, field: str, lexicon: Lexicon) -> Column:
    labels, pattern = lexicon.header[field]
    known = sorted(((plain_label(x), i) for i, x in enumerate(labels) if plain_label(x)), key=lambda t: (-len(t[0]), t[1]))
    starts = "|".join(label_expression(label) for label, _ in known)

    def hits(near: Column) -> Column:
        return F.concat(*[F.filter(F.transform(near, lambda x: x.withField("end", label_end(x["folded"], label))), lambda x: x["end"] > 0) for label, _ in known])  # noqa: B023

    def one(x: Column) -> Column:
        def of(found: Column) -> Column:
            return F.when(found.isNotNull(), F.struct(found["value"].alias("value"), found["raw"].alias("raw"), x["page"].alias("page"), x["box"].alias("box")))

        return let(let(remainder(x["text"], x["end"]), lambda rest: _field_value(field, pattern, rest)), of)

    near = F.filter(folded, lambda x: x["folded"].rlike(starts))
    return F.filter(F.transform(let(near, hits), one), lambda x: x.isNotNull()).cast(f"array<{HIT}>")


def label_hits(lines: Column, field: str, lexicon: Lexicon = DEFAULT) -> Column:
    """All usable hits of a field, best first: the longer label, then its place in the lexicon, then the line. A label
    must begin its line; a hit without a value falls through to the next."""
    return let(_folded(lines), lambda folded: _hits(folded, field, lexicon))


def header_fields(lines: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """For each header field its first hit, or null, as a struct. Lines are folded once for all fields."""
    return let(_folded(lines), lambda folded: F.struct(*[F.get(_hits(folded, f, lexicon), F.lit(0)).alias(f) for f in lexicon.header]))


def vat_lines(lines: Column) -> Column:
    """rate and tax of lines such as "MwSt 19 %: 218,25", the first of each rate; the net is left to the solver."""
    def one(x: Column) -> Column:
        tax = parse_amount(F.regexp_extract(x["text"], VAT_LINE, 3))
        return F.when(x["text"].rlike(VAT_LINE) & tax.isNotNull(), F.struct(F.regexp_extract(x["text"], VAT_LINE, 2).try_cast("double").alias("rate"), F.lit(None).cast("string").alias("net"), tax.alias("tax")))

    found = F.filter(F.transform(lines, one), lambda v: v.isNotNull())
    return F.filter(found, lambda v, i: F.array_position(F.transform(found, lambda w: w["rate"]), v["rate"]) == i + 1)


def classify_columns(header: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """An index for each of COLUMNS, or null: keys take the first free column that fits, in their order. Null for a
    table without a description, or with neither a total nor a price."""
    normed = F.transform(header, lambda h: normalize_label(F.coalesce(h, F.lit(""))))
    keys = F.array(*[F.array(*[F.lit(plain_label(x)) for x in lexicon.table[k]]) for k in COLUMNS])

    def step(taken: Column, words: Column) -> Column:
        def fits(h: Column, i: Column) -> Column:
            good = F.exists(words, lambda w: (h == w) | ((F.length(w) >= 3) & F.contains(h, w)))
            return F.when((h != "") & good & ~F.coalesce(F.array_contains(taken, i), F.lit(False)), i)

        first = F.get(F.filter(F.transform(normed, fits), lambda i: i.isNotNull()), F.lit(0))
        return F.concat(taken, F.array(first))

    def enough(found: Column) -> Column:
        return F.when(F.get(found, F.lit(0)).isNotNull() & (F.get(found, F.lit(1)).isNotNull() | F.get(found, F.lit(2)).isNotNull()), found)

    return let(F.aggregate(keys, F.array().cast("array<int>"), step), enough)


def rule_items(tables: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Items of the first table that can be classified and has any; null without one."""
    mode = F.lit(COLUMNS.index("position"))

    def one(t: Column) -> Column:
        def of(columns: Column) -> Column:
            return F.when(columns.isNotNull(), line_items(t["rows"], columns, F.when(F.get(columns, mode).isNotNull(), F.lit(NO_NUMBER)).otherwise(F.lit("none"))))

        return let(classify_columns(t["header"], lexicon), of)

    return F.get(F.filter(F.transform(tables, one), lambda items: F.size(items) > 0), F.lit(0))


def currency(text: Column) -> Column:
    def marked(code: str, sign: str) -> Column:
        return text.rlike(rf"(?<![A-Za-z0-9_]){code}(?![A-Za-z0-9_])|{sign}")

    return F.when(marked("EUR", "€"), "EUR").when(marked("USD", r"\$"), "USD").when(marked("GBP", "£"), "GBP")


def run_rules(lines: Column, tables: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """invoice_number, issue_date, due_date, net, tax, gross (hits), vat, items, currency, found and missed."""
    hits = tuple(lexicon.header)
    text = F.array_join(F.transform(lines, lambda x: x["text"]), " ")
    made = F.struct(header_fields(lines, lexicon).alias("header"), vat_lines(lines).alias("vat"), rule_items(tables, lexicon).alias("items"), currency(text).alias("currency"))

    def told(r: Column) -> Column:
        present = {**{k: r["header"][k].isNotNull() for k in hits}, "line_items": r["items"].isNotNull()}
        found = F.array(*[F.when(v, F.lit(k)) for k, v in present.items()], F.when(F.size(r["vat"]) > 0, F.lit("vat_breakdown")))
        missed = F.array(*[F.when(~v, F.lit(k)) for k, v in present.items()])
        return F.struct(
            *[r["header"][k].alias(k) for k in hits],
            *[r[k].alias(k) for k in ("vat", "items", "currency")],
            F.filter(found, lambda x: x.isNotNull()).alias("found"),
            F.filter(missed, lambda x: x.isNotNull()).alias("missed"),
        )

    return let(made, told)
