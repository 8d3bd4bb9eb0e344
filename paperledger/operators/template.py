"""Vendor templates: applied to positioned text or to words of a scan, and induced from a reconciled invoice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.amounts import bare_number, cell_to_dot, number_equal, parse_amount, render_amount
from ..functions.boxes import distance, inflate, intersects
from ..functions.dates import parse_date_listed, render_date
from ..functions.identity import normalize_iban, plausible_tax_number, valid_iban, valid_vat_id, vendor_name_hash
from ..functions.text import SPACE, SPACE_SIGNS, bound, generalize_pattern, label_before, label_end_anywhere, let, normalize_label, spaced, trim
from ..plans.schemas import BOX, FIELD, ITEM_TABLE, TEMPLATE
from .layout import band_of, merged_lines
from .line_items import COLUMNS, NO_NUMBER, line_items
from .rules import DEFAULT, Lexicon, plain_label

#: How far a region reaches beyond its box, the ladder of confidences, the share of a table's headings
#: that must be found, and the words that end a table of items.
REACH = 0.05
LADDER = ((0.95, "region", "label", "pattern"), (0.8, "region", "pattern"), (0.75, "label", "pattern"), (0.6, "label"), (0.5, "region"), (0.3,))
SIGNATURE_SHARE = 0.7
STOP_ROW = spaced(r"(?i)zwischensumme|gesamtbetrag|rechnungsbetrag|endbetrag|summe|mwst|umsatzsteuer|total|amount\s+due")
FIELDS = ("invoice_number", "issue_date", "due_date", "net", "tax", "gross")
ROW_CONFIDENCE, NAME_CONFIDENCE, OCR_CONFIDENCE = 0.85, 0.9, 0.7
FORMATS_TRIED = ("dd.MM.yyyy", "d.M.yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yy")
FORMATS_ASSUMED = ("dd.MM.yyyy", "yyyy-MM-dd")
AMOUNT_PATTERN = r"-?[\d.,]+"
KEY_LENGTH = 20


def confidence(region: Column, label: Column, pattern: Column) -> Column:
    """The rung of the ladder for the anchors that matched."""
    has = {"region": region, "label": label, "pattern": pattern}
    out = F.lit(LADDER[-1][0])
    for value, *needs in reversed(LADDER[:-1]):
        met = F.lit(True)
        for n in needs:
            met = met & has[n]
        out = F.when(met, F.lit(value)).otherwise(out)
    return out


def line_below(x: Column, lines: Column) -> Column:
    """The highest of the lines of the same page that begin under a line and overlap it from the side, or null."""
    under = F.filter(lines, lambda y: (y["page"] == x["page"]) & (y["box"]["y0"] > x["box"]["y1"] - 0.005) & (y["box"]["x0"] < x["box"]["x1"]) & (x["box"]["x0"] < y["box"]["x1"]))
    return F.array_min(F.transform(under, lambda y, i: F.struct(y["box"]["y0"].alias("y"), i.alias("i"), y.alias("line"))))["line"]


def _normed(lines: Column) -> Column:
    """Lines with the normal forms of their texts."""
    return F.transform(lines, lambda x: F.struct(x["page"].alias("page"), x["box"].alias("box"), x["text"].alias("text"), normalize_label(x["text"]).alias("norm")))


def find_field(d: Column, lines: Column, page_count: Column) -> Column:
    """The hit of a field's descriptor: raw, confidence, page and box, or null. Lines near the region come first, the
    nearest leading; a label must be in the line, and its value follows it or stands in the next line below."""
    return bound(_hit, d, _normed(lines), page_count)


def _hit(d: Column, lines: Column, page_count: Column) -> Column:
    """``find_field`` for lines that ``_normed`` gave."""
    has_region, has_label, has_pattern = d["box"].isNotNull(), d["label"].isNotNull(), d["value_pattern"].isNotNull()

    def near(page: Column, region: Column) -> Column:
        inside = F.filter(lines, lambda x: (x["page"] == page) & intersects(x["box"], region))
        return F.transform(F.sort_array(F.transform(inside, lambda x, i: F.struct(distance(x["box"], d["box"]).alias("d"), i.alias("i"), x.alias("line")))), lambda k: k["line"])

    def tried(text: Column, labelled: Column, x: Column) -> Column:
        def made(raw: Column) -> Column:
            got = F.struct(raw.alias("raw"), confidence(has_region, labelled, has_pattern).alias("confidence"), x["page"].alias("page"), x["box"].alias("box"))
            return F.when(F.coalesce(raw, F.lit("")) != "", got)

        return let(let(trim(text), lambda bare: F.when(has_pattern, F.call_function("regexp_extract", bare, d["value_pattern"], F.lit(0))).otherwise(bare)), made)

    def search(candidates: Column) -> Column:
        def by_label(x: Column) -> Column:
            rest = F.regexp_replace(F.coalesce(F.substring(x["text"], label_end_anywhere(x["text"], d["label"]) + 1, F.length(x["text"])), F.lit("")), rf"^[:{SPACE_SIGNS}]+", "")
            return F.coalesce(tried(rest, F.lit(True), x), let(line_below(x, candidates), lambda y: F.when(y.isNotNull(), tried(y["text"], F.lit(True), y))))

        labelled = let(normalize_label(d["label"]), lambda label: F.filter(candidates, lambda x: F.contains(x["norm"], label)))
        hits = F.when(has_label, F.transform(labelled, by_label)).otherwise(F.transform(candidates, lambda x: tried(x["text"], F.lit(False), x)))
        return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))

    by_region = bound(near, F.when(d["page"] == -1, page_count).otherwise(d["page"]), inflate(d["box"], REACH))
    return F.when(d.isNotNull(), let(F.when(has_region, by_region).otherwise(lines), search))


def match_table(tables: Column, header: Column) -> Column:
    """The table with the greatest share of the signature among its headings, if that is 0.7 or more; the first of
    equals."""
    def of(signature: Column) -> Column:
        def scored(t: Column) -> Column:
            def score(heads: Column) -> Column:
                hits = F.size(F.filter(signature, lambda s: F.exists(heads, lambda h: F.contains(h, s))))
                return F.struct((hits / F.size(signature)).alias("score"), t.alias("table"))

            return let(F.transform(t["header"], normalize_label), score)

        def first(ranked: Column) -> Column:
            return let(F.array_max(F.transform(ranked, lambda s: s["score"])), lambda best: F.get(F.filter(ranked, lambda s: s["score"] == best), F.lit(0))["table"])

        found = let(F.filter(F.transform(tables, scored), lambda s: s["score"] >= SIGNATURE_SHARE), first)
        return F.when(F.size(signature) > 0, found)

    return let(F.filter(F.transform(header, normalize_label), lambda s: s != ""), of)


def _columns(m: Column) -> Column:
    return F.array(*[F.try_element_at(m, F.lit(n)) for n in COLUMNS])


def _values(t: Column, lines: Column, page_count: Column, use) -> Column:
    """What ``use`` makes of each field's hit with a value, or null. One search serves all fields."""
    asked = F.array(*[F.try_element_at(t["fields"], F.lit(f)) for f in FIELDS])

    def valued(name: str, h: Column) -> Column:
        value = parse_date_listed(h["raw"], t["date_formats"]) if name.endswith("_date") else parse_amount(h["raw"], t["decimal"]) if name in ("net", "tax", "gross") else h["raw"]
        return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), h["raw"].alias("raw"), h["confidence"].alias("confidence"), h["page"].alias("page"), h["box"].alias("box"))))

    def named(hits: Column) -> Column:
        return use({f: _bound(F.get(hits, F.lit(i)), lambda h: valued(f, h)) for i, f in enumerate(FIELDS)})  # noqa: B023

    hits = bound(lambda lines, page_count: F.transform(asked, lambda d: _hit(d, lines, page_count)), _normed(lines), page_count)
    return let(hits, named)


def _bound(value: Column, use) -> Column:
    return let(value, lambda h: F.when(h.isNotNull(), use(h)))


def apply_template(t: Column, lines: Column, tables: Column, page_count: Column) -> Column:
    """Fields, items and the seller of a document under a vendor's template; the seller always comes from the template."""
    def use(t: Column, lines: Column, tables: Column, page_count: Column) -> Column:
        table = t["item_table"]
        items = _bound(match_table(tables, table["header"]), lambda found: line_items(found["rows"], _columns(table["columns"]), table["continuation"], t["decimal"]))
        kept = let(items, lambda x: F.when(table.isNotNull() & (F.size(x) > 0), x))
        return _values(t, lines, page_count, lambda values: _applied(t, values, kept, ROW_CONFIDENCE, "template"))

    return bound(use, t, lines, tables, page_count)


def _applied(t: Column, values: dict[str, Column], items: Column, rows: float, source: str) -> Column:
    ids = t["vendor_ids"]
    seller = F.struct(ids["display_name"].alias("name"), ids["vat_id"].alias("vat_id"), ids["tax_number"].alias("tax_number"), F.coalesce(ids["ibans"], F.array().cast("array<string>")).alias("ibans"))
    return F.struct(*[v.alias(k) for k, v in values.items()], items.alias("items"), seller.alias("seller"), F.lit(rows).alias("row_confidence"), F.lit(source).alias("row_source"))


def ocr_rows(t: Column, merged: Column) -> Column:
    """Rows of cells from merged lines below the line that holds the headings, by the bands of these, until a line of
    totals; null without such a line. Missing headings leave empty cells."""
    def of(merged: Column, signature: Column, width: Column) -> Column:
        def starts(tokens: Column) -> Column:
            def start(s: Column) -> Column:
                fits = F.filter(tokens, lambda k: (k["norm"] == s) | ((F.length(s) >= 3) & F.contains(k["norm"], s)))
                return F.get(fits, F.lit(0))["x0"]

            return F.transform(signature, start)

        def found(x: Column) -> Column:
            tokens = F.transform(x["tokens"], lambda k: F.struct(normalize_label(k["text"]).alias("norm"), k["box"]["x0"].alias("x0")))
            return F.struct(x.alias("line"), let(tokens, starts).alias("starts"))

        heads = F.filter(F.transform(merged, found), lambda h: (F.size(signature) > 0) & (F.size(F.filter(h["starts"], lambda s: s.isNotNull())) >= SIGNATURE_SHARE * F.size(signature)))
        return _bound(F.get(heads, F.lit(0)), lambda head: rows(merged, head, width))

    def rows(merged: Column, head: Column, width: Column) -> Column:
        known = F.sort_array(F.filter(F.transform(head["starts"], lambda s, i: F.when(s.isNotNull(), F.struct(s.alias("x"), i.alias("i")))), lambda k: k.isNotNull()))
        under = F.filter(merged, lambda x: (x["page"] == head["line"]["page"]) & (x["box"]["y0"] > head["line"]["box"]["y1"] - 0.002))
        ordered = F.transform(F.sort_array(F.transform(under, lambda x, i: F.struct(x["box"]["y0"].alias("y"), i.alias("i"), x.alias("line")))), lambda k: k["line"])
        return bound(lambda body, bands: let(F.struct(F.transform(bands, lambda k: k["x"]).alias("edges"), F.transform(bands, lambda k: k["i"]).alias("columns")), lambda b: cut(body, b["edges"], b["columns"], width)), let(ordered, upto_totals), known)

    def upto_totals(ordered: Column) -> Column:
        stop = F.array_position(F.transform(ordered, lambda x: x["text"].rlike(STOP_ROW)), F.lit(True))
        return let(stop, lambda stop: F.when(stop > 0, F.slice(ordered, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(ordered))

    def cut(body: Column, edges: Column, columns: Column, width: Column) -> Column:
        def cells(x: Column) -> Column:
            def made(placed: Column) -> Column:
                texts = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.array_join(F.transform(F.filter(placed, lambda p: p["c"] == c), lambda p: p["text"]), " "))
                return F.when(F.exists(placed, lambda p: p["c"].isNotNull()), texts)

            return let(F.transform(x["tokens"], lambda k: F.struct(F.get(columns, band_of(k["box"]["x0"], k["box"]["x1"], edges)).alias("c"), k["text"].alias("text"))), made)

        return F.filter(F.transform(body, cells), lambda r: r.isNotNull())

    header = t["item_table"]["header"]
    return bound(of, merged, F.filter(F.transform(header, normalize_label), lambda s: s != ""), F.size(header))


def apply_template_ocr(t: Column, merged: Column, page_count: Column) -> Column:
    """The same for words of a scan. ``merged``: a column of visual lines, from ``merged_lines``; items come from bands
    where these give any."""
    def use(t: Column, merged: Column, page_count: Column) -> Column:
        table = t["item_table"]
        items = _bound(ocr_rows(t, merged), lambda rows: line_items(rows, _columns(table["columns"]), table["continuation"], t["decimal"]))
        kept = let(items, lambda x: F.when(table.isNotNull() & (F.size(x) > 0), x))
        return _values(t, merged, page_count, lambda values: _applied(t, values, kept, OCR_CONFIDENCE, "ocr"))

    return bound(use, t, merged, page_count)


def _find(lines: Column, variants: Column) -> Column:
    """The first line that holds a variant: line, start (signs before it) and matched; variants in their order."""
    def of(variants: Column) -> Column:
        def one(x: Column) -> Column:
            hit = F.get(F.filter(variants, lambda v: (v != "") & F.contains(x["text"], v)), F.lit(0))
            return _bound(hit, lambda v: F.struct(x.alias("line"), (F.instr(x["text"], v) - 1).alias("start"), v.alias("matched")))

        return F.get(F.filter(F.transform(lines, one), lambda h: h.isNotNull()), F.lit(0))

    return let(variants, of)


def variants(value: Column, decimal: Column) -> Column:
    return F.array(render_amount(value, decimal, True), render_amount(value, decimal, False))


def detect_decimal(probes: Column, lines: Column) -> Column:
    """The separator of the first amount that the page prints in one locale's way alone; a comma without any."""
    def proof(value: Column) -> Column:
        def told(de: Column, en: Column) -> Column:
            return bound(lambda hit_de, hit_en: F.when(hit_de != hit_en, F.when(hit_de, F.lit(",")).otherwise(F.lit("."))), *[_find(lines, F.array_except(a, b)).isNotNull() for a, b in ((de, en), (en, de))])

        return bound(told, variants(value, F.lit(",")), variants(value, F.lit(".")))

    some = F.filter(probes, lambda p: F.coalesce(p, F.lit("")) != "")
    found = F.aggregate(some, F.lit(None).cast("string"), lambda a, p: F.when(a.isNotNull(), a).otherwise(proof(p)))
    return F.coalesce(found, F.lit(","))


def descriptor(hit: Column, pattern: Column, page_count: Column) -> Column:
    page = F.when((page_count > 1) & (hit["line"]["page"] == page_count), F.lit(-1)).otherwise(hit["line"]["page"])
    return F.struct(label_before(hit["line"]["text"], hit["start"]).alias("label"), pattern.alias("value_pattern"), page.alias("page"), hit["line"]["box"].cast(BOX).alias("box")).cast(FIELD)


def induce_fields(c: Column, lines: Column, page_count: Column, decimal: Column, formats: Column) -> Column:
    """A map of the header fields that the page shows. An amount must read back as itself under the separator."""
    entries = [F.struct(F.lit("invoice_number").alias("k"), _bound(_find(lines, F.array(c["invoice_number"])), lambda h: descriptor(h, generalize_pattern(c["invoice_number"]), page_count)).alias("v"))]
    for f in ("issue_date", "due_date"):
        def rendered(fmt: Column) -> Column:
            return F.coalesce(*[F.when(fmt == k, render_date(c[f], k)) for k in FORMATS_TRIED])  # noqa: B023

        shown = F.filter(F.transform(formats, rendered), lambda v: v.isNotNull())
        hits = F.filter(F.transform(shown, lambda v: _find(lines, F.array(v))), lambda h: h.isNotNull())
        entries.append(F.struct(F.lit(f).alias("k"), _bound(F.get(hits, F.lit(0)), lambda h: descriptor(h, generalize_pattern(h["matched"]), page_count)).alias("v")))
    for f in ("gross", "net", "tax"):
        value = c["totals"][f]
        hit = _find(lines, variants(value, decimal))
        entries.append(F.struct(F.lit(f).alias("k"), _bound(hit, _guarded(value, decimal, page_count)).alias("v")))
    kept = F.filter(F.array(*[e.cast(f"struct<k:string,v:{FIELD}>") for e in entries]), lambda e: e["v"].isNotNull())
    return F.map_from_entries(kept)


def _guarded(value: Column, decimal: Column, page_count: Column):
    return lambda h: F.when(parse_amount(h["matched"], decimal) == value, descriptor(h, F.lit(AMOUNT_PATTERN), page_count))


def column_votes(items: Column, table: Column, decimal: Column) -> Column:
    """For each item whose description begins a cell of a row, a vote (key, column) for each cell that shows one of its
    values."""
    def shown(raw: Column) -> Column:
        """A cell's text, its normal form and its number."""
        return bound(lambda v, norm: F.struct(v.alias("v"), norm.alias("norm"), bare_number(cell_to_dot(v, decimal)).alias("dot")), trim(raw), normalize_label(raw))

    def cell(x: Column, c: Column, i: Column) -> Column:
        v = c["v"]
        rate = v.contains("%") & number_equal(cell_to_dot(F.replace(v, F.lit("%"), F.lit("")), decimal), F.regexp_replace(x["tax_rate"].cast("string"), r"\.0$", ""))
        met = {
            "description": F.startswith(c["norm"], x["key"]),
            "position": v == x["position"],
            "quantity": c["dot"] == x["quantity"],
            "unit_price": c["dot"] == x["unit_price"],
            "line_total": c["dot"] == x["line_total"],
            "tax_rate": rate,
            "unit": v == x["unit"],
        }
        votes = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(n).alias("key"), i.alias("column"))) for n, t in met.items()])
        return F.when(v != "", F.filter(votes, lambda w: w.isNotNull())).otherwise(F.array().cast("array<struct<key:string,column:int>>"))

    def known(x: Column) -> Column:
        """An item's key and its values as cells show them."""
        numbers = [bare_number(x[n]).alias(n) for n in ("quantity", "unit_price", "line_total")]
        return F.struct(F.substring(normalize_label(x["description"]), 1, KEY_LENGTH).alias("key"), x["position"].cast("string").alias("position"), *numbers, x["tax_rate"].alias("tax_rate"), x["unit"].alias("unit"))

    def of(rows: Column) -> Column:
        def voted(x: Column) -> Column:
            row = F.get(F.filter(rows, lambda r: F.exists(r, lambda c: F.startswith(c["norm"], x["key"]))), F.lit(0))
            return let(row, lambda r: F.flatten(F.transform(r, lambda c, i: cell(x, c, i))))

        return F.flatten(F.filter(F.transform(F.transform(items, known), voted), lambda v: v.isNotNull()))

    return let(F.transform(table["rows"], lambda r: F.transform(r, shown)), of)


def assign_columns(found: Column) -> Column:
    """For each key in the order of COLUMNS the column with the most votes that no earlier key took; the one that was
    voted for first wins ties."""
    return let(found, _assigned)


def _assigned(votes: Column) -> Column:
    def step(taken: Column, key: Column) -> Column:
        def most(own: Column) -> Column:
            ranked = F.transform(F.array_distinct(own), lambda c, i: F.struct(F.size(F.filter(own, lambda o: o == c)).alias("n"), (-i).alias("i"), c.alias("c")))
            return F.array_max(ranked)["c"]

        own = F.filter(F.transform(F.filter(votes, lambda v: v["key"] == key), lambda v: v["column"]), lambda c: ~F.coalesce(F.array_contains(taken, c), F.lit(False)))
        return F.concat(taken, F.array(let(own, most)))

    return F.aggregate(F.array(*map(F.lit, COLUMNS)), F.array().cast("array<int>"), step)


def induce_table(items: Column, tables: Column, decimal: Column) -> Column:
    """The item table of a template: from the table with the most descriptions, columns by votes; null without one."""
    keys = F.filter(F.transform(items, lambda x: F.substring(normalize_label(x["description"]), 1, KEY_LENGTH)), lambda k: k != "")

    def best(keys: Column, tables: Column) -> Column:
        def scored(t: Column, i: Column) -> Column:
            norms = F.flatten(F.transform(t["rows"], lambda r: F.transform(r, normalize_label)))
            hits = let(norms, lambda norms: F.size(F.filter(keys, lambda k: F.exists(norms, lambda v: F.startswith(v, k)))))
            return F.struct(hits.alias("hits"), (-i).alias("i"))

        return let(F.array_max(F.transform(tables, scored)), lambda b: F.when(b["hits"] > 0, F.get(tables, -b["i"])))

    def of(t: Column) -> Column:
        def made(columns: Column) -> Column:
            def told(at: Column, description: Column) -> Column:
                loose = F.exists(t["rows"], lambda r: ~F.coalesce(trim(F.get(r, at)).rlike("^[0-9]+$"), F.lit(False)) & (F.coalesce(trim(F.get(r, description)), F.lit("")) != ""))
                mode = F.when(at.isNotNull() & loose, F.lit(NO_NUMBER)).otherwise(F.lit("none"))
                return F.when(description.isNotNull(), F.struct(t["header"].alias("header"), _column_map(columns).alias("columns"), mode.alias("continuation")))

            return bound(told, F.get(columns, F.lit(COLUMNS.index("position"))), F.get(columns, F.lit(0)))

        return let(assign_columns(column_votes(items, t, decimal)), made)

    return _bound(bound(best, keys, tables), of).cast(ITEM_TABLE)


def _column_map(columns: Column) -> Column:
    entries = F.array(*[F.struct(F.lit(n).alias("k"), F.get(columns, F.lit(i)).alias("v")) for i, n in enumerate(COLUMNS)])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def induce_ocr_table(merged: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The item table of a scan: the first line of three words or more that fit three columns, a description and a total
    or price among them. Keys take words in the lexicon's order."""
    names = tuple(lexicon.table)
    words = F.array(*[F.array(*[F.lit(plain_label(x)) for x in lexicon.table[k]]) for k in names])

    def columns(normed: Column) -> Column:
        def step(taken: Column, own: Column) -> Column:
            def fits(h: Column, i: Column) -> Column:
                good = (h != "") & F.exists(own, lambda w: (h == w) | ((F.length(w) >= 3) & F.contains(h, w)))
                return F.when(~F.coalesce(F.array_contains(taken, i), F.lit(False)) & good, i)

            return F.concat(taken, F.array(F.get(F.filter(F.transform(normed, fits), lambda i: i.isNotNull()), F.lit(0))))

        return F.aggregate(words, F.array().cast("array<int>"), step)

    def made(x: Column) -> Column:
        def use(found: Column) -> Column:
            at = {n: F.get(found, F.lit(i)) for i, n in enumerate(names)}
            good = (F.size(F.filter(found, lambda i: i.isNotNull())) >= 3) & at["description"].isNotNull() & (at["line_total"].isNotNull() | at["unit_price"].isNotNull())
            entries = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), c.alias("v")) for n, c in at.items()]), lambda e: e["v"].isNotNull())
            mode = F.when(at["position"].isNotNull(), F.lit(NO_NUMBER)).otherwise(F.lit("none"))
            return F.when(good, F.struct(F.transform(x["tokens"], lambda k: k["text"]).alias("header"), F.map_from_entries(entries).alias("columns"), mode.alias("continuation")))

        return let(let(F.transform(x["tokens"], lambda k: normalize_label(k["text"])), columns), use)

    found = F.transform(F.filter(merged, lambda x: F.size(x["tokens"]) >= 3), made)
    return F.get(F.filter(found, lambda t: t.isNotNull()), F.lit(0)).cast(ITEM_TABLE)


def induce_template(c: Column, lines: Column, tables: Column, page_count: Column) -> Column:
    """A vendor's template from a canonical invoice and the page it was read from."""
    return bound(_induced, c, lines, tables, page_count)


def _induced(c: Column, lines: Column, tables: Column, page_count: Column) -> Column:
    amounts = F.concat(
        F.array(c["totals"]["gross"], c["totals"]["net"], c["totals"]["tax"]),
        F.flatten(F.transform(c["vat_breakdown"], lambda v: F.array(v["net"], v["tax"]))),
        F.flatten(F.transform(c["line_items"], lambda x: F.array(x["line_total"], x["unit_price"]))),
    )

    def use(decimal: Column) -> Column:
        shown = F.array(*[F.when(_find(lines, F.array(render_date(c["issue_date"], f))).isNotNull(), F.lit(f)) for f in FORMATS_TRIED])
        kept = F.filter(shown, lambda f: f.isNotNull())
        return let(let(kept, lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(*map(F.lit, FORMATS_ASSUMED)))), lambda formats: made(decimal, formats))

    def made(decimal: Column, formats: Column) -> Column:
        table = F.when(F.size(tables) > 0, induce_table(c["line_items"], tables, decimal)).otherwise(induce_ocr_table(merged_lines(lines)))
        s = c["seller"]
        ibans = let(F.filter(F.transform(s["ibans"], normalize_iban), valid_iban), lambda i: F.when(F.size(i) > 0, i))
        ids = F.struct(
            F.when(valid_vat_id(s["vat_id"]), F.upper(F.regexp_replace(s["vat_id"], r"\s+", ""))).alias("vat_id"),
            F.when(plausible_tax_number(s["tax_number"]), s["tax_number"]).alias("tax_number"),
            ibans.alias("ibans"),
            vendor_name_hash(s["name"], s["address"]["postal_code"]).alias("name_hash"),
            s["name"].alias("display_name"),
        )
        fields = induce_fields(c, lines, page_count, decimal, formats)
        return F.struct(F.lit(1).alias("template_version"), ids.alias("vendor_ids"), decimal.alias("decimal"), formats.alias("date_formats"), fields.alias("fields"), table.alias("item_table")).cast(TEMPLATE)

    return let(detect_decimal(amounts, lines), use)


def useful(t: Column) -> Column:
    """Worth keeping: two fields or a table of items."""
    return (F.size(F.map_keys(t["fields"])) >= 2) | t["item_table"].isNotNull()
