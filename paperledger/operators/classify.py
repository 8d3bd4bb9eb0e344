"""Document type by weighted features, and the plain Markdown rendition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.dates import parse_date
from ..functions.identity import valid_vat_id
from ..functions.text import SPACE, spaced, trim
from ..plans.options import Classify

#: What the features look for. An ASCII word boundary is written out, as the engine's own is Unicode's.
_BEGIN, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
HEADING = spaced(rf"(?i){_BEGIN}(rechnung|invoice|gutschrift|credit\s?note){_END}")
NUMBER_LABEL = spaced(r"(?i)(rechnungs?-?\s?(nr|nummer)|invoice\s?(no|number|#)|beleg-?(nr|nummer))")
NUMBER_SHAPE = r"[A-Za-z]{0,4}[-/]?[0-9][0-9A-Za-z\-/._]{2,}"
VAT_ID = spaced(rf"{_BEGIN}DE\s?[0-9]{{9}}{_END}")
TAX_LABEL, TAX_SHAPE = r"(?i)steuernummer|steuer-?nr", r"[0-9]{2,3}/[0-9]{3,4}/[0-9]{4,5}|[0-9]{10,13}"
DATE_LABEL, DATE_SHAPE = spaced(r"(?i)(rechnungs|beleg|invoice)\s?-?\s?(datum|date)|date\s+of\s+issue"), r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}"
VAT_BLOCK = spaced(r"(?i)(mwst|mehrwertsteuer|ust|umsatzsteuer|vat|tax)[^%0-9]{0,20}(19|7|0)\s?%[^0-9]{0,10}-?[0-9.,]+")
TOP, HEADING_LENGTH, COLUMN_SHARE = 0.25, 60, 0.6


def _amount_table(t: Column) -> Column:
    def column(c: Column) -> Column:
        cells = F.filter(F.transform(t["rows"], lambda r: F.coalesce(F.get(r, c), F.lit(""))), lambda v: trim(v) != "")
        good = F.filter(cells, lambda v: parse_amount(v).isNotNull() & F.regexp_replace(trim(v), rf"(?i){SPACE}*(EUR|€)$", "").rlike(r"[.,][0-9]{2}$"))
        return (F.size(cells) > 0) & (F.size(good) >= COLUMN_SHARE * F.size(cells))

    columns = F.array_max(F.transform(t["rows"], lambda r: F.size(r)))
    return F.when(F.size(t["rows"]) > 0, F.exists(F.sequence(F.lit(0), F.greatest(columns - 1, F.lit(0))), column)).otherwise(F.lit(False))


def features(lines: Column, tables: Column) -> dict[str, Column]:
    """Each feature of arrays of lines (text, page, box, tag) and tables (rows), as a boolean."""
    text = F.array_join(F.transform(lines, lambda x: x["text"]), "\n")
    heading = F.exists(lines, lambda x: (F.coalesce(x["tag"].isin("section_header", "title"), F.lit(False)) | ((x["page"] == 1) & (x["box"]["y0"] < TOP))) & x["text"].rlike(HEADING) & (F.length(trim(x["text"])) < HEADING_LENGTH))
    tax = F.exists(F.regexp_extract_all(text, F.lit(VAT_ID), F.lit(0)), valid_vat_id) | F.exists(lines, lambda x: x["text"].rlike(TAX_LABEL) & x["text"].rlike(TAX_SHAPE))
    return {
        "heading_keyword": heading,
        "number_pattern": F.exists(lines, lambda x: x["text"].rlike(NUMBER_LABEL) & x["text"].rlike(NUMBER_SHAPE)),
        "tax_id": tax,
        "labelled_date": F.exists(lines, lambda x: F.when(x["text"].rlike(DATE_LABEL), parse_date(F.regexp_extract(x["text"], DATE_SHAPE, 0)).isNotNull()).otherwise(F.lit(False))),
        "vat_block": F.exists(lines, lambda x: x["text"].rlike(VAT_BLOCK)),
        "amount_table": F.exists(tables, _amount_table),
    }


def band(score: Column, options: Classify) -> Column:
    return F.when(score >= options.invoice_min, "invoice").when(score <= options.non_invoice_max, "non_invoice").otherwise("uncertain")


def classify(lines: Column, tables: Column, options: Classify | None = None) -> Column:
    """features (a map of 0 and 1), score and band. Features without a weight count nothing."""
    options = options or Classify()
    on = F.create_map(*[x for k, v in features(lines, tables).items() for x in (F.lit(k), F.when(v, 1).otherwise(0))])
    weights = F.create_map(*[F.lit(x) for k in options.weights for x in (k, options.weights[k])])

    def of(m: Column) -> Column:
        score = F.aggregate(F.map_entries(m), F.lit(0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(weights, e["key"]), F.lit(0)))
        return F.struct(m.alias("features"), score.alias("score"), band(score, options).alias("band"))

    return F.get(F.transform(F.array(on), of), F.lit(0))


def markdown(lines: Column, tables: Column) -> Column:
    """Rules between pages, headings, all text and then all tables; cells as they are."""
    def one(x: Column, i: Column) -> Column:
        turned = F.when(i == 0, x["page"] > 1).otherwise((F.get(lines, i - 1)["page"] != x["page"]) & (x["page"] > 1))
        shown = F.when(x["tag"].isin("section_header", "title"), F.concat(F.lit("## "), x["text"])).otherwise(x["text"])
        return F.when(turned, F.concat(F.lit("\n---\n\n"), shown)).otherwise(shown)

    def row(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def table(t: Column) -> Column:
        head = F.array(F.lit(""), row(t["header"]), row(F.transform(t["header"], lambda _: F.lit("---"))))
        return F.concat(head, F.transform(t["rows"], row))

    return F.array_join(F.concat(F.transform(lines, one), F.flatten(F.transform(tables, table))), "\n")
