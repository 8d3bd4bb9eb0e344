"""Operators on small documents, and the golden scenarios through the batch plan."""

import json

import pytest
from pyspark.sql import functions as F

from paperledger.operators import cii, classify, gate, layout, line_items, merge, reconcile, records, rules, segment, vendors
from paperledger.plans import options, schemas
from paperledger.queries.records import CII
from paperledger.sources import ports


def line(text, y=0.1, page=1, tag=None, x=0.1, w=0.5, tokens=None):
    box = {"x0": x, "y0": y, "x1": x + w, "y1": y + 0.01}
    return {"ix": 0, "text": text, "page": page, "box": box, "tag": tag, "tokens": tokens or [{"text": text, "page": page, "box": box}]}


def document(spark, lines, tables=(), pages=1, doc_id="d"):
    rows = [(doc_id, pages, list(lines), [{"page": 1, "box": {"x0": 0.0, "y0": 0.4, "x1": 1.0, "y1": 0.6}, "header": h, "rows": r} for h, r in tables], None)]
    return spark.createDataFrame(rows, schemas.POSITIONED)


def one(df, column):
    return df.select(column.alias("v")).first().v


def invoice(**given):
    fields = {f.name: None for f in schemas.struct_type(schemas.INVOICE).fields}
    return fields | given


ITEM = {"position": None, "description": "A", "quantity": None, "unit": None, "unit_price": None, "tax_rate": None, "line_total": None}
HEADER = {"invoice_number": "R-1", "issue_date": "2026-01-31", "seller": {"name": "S", "vat_id": None, "tax_number": None, "ibans": [], "address": None}}


META = {"totals.net": {"source": "rules", "confidence": 0.65, "raw_text": None, "page": None, "box": None}}


@pytest.fixture(scope="module")
def solved(spark):
    """All cases below through one plan, by name."""
    zero = {"totals": {"net": "1000.00", "tax": "0.00", "gross": "1000.00"}, "vat_breakdown": [{"rate": 0.0, "net": None, "tax": "0.00"}], "line_items": [FULL["line_items"][0] | {"quantity": "10", "unit_price": "100", "tax_rate": 0.0, "line_total": "1000.00"}]}
    bad = {**HEADER, "totals": {"net": "1.00", "tax": "1.00", "gross": "9.00"}, "vat_breakdown": [], "line_items": [ITEM | {"line_total": "5.00"}]}
    cases = {"full": FULL, "zero": {**FULL, **zero}, "bad": bad, "bare": HEADER, "day": {**FULL, "issue_date": "2026-02-30"}}
    cases |= {k: {**FULL, **v} for k, v in (ERASED | BROKEN).items()}
    df = spark.createDataFrame([(k, invoice(**v), META) for k, v in cases.items()], schemas.ENVELOPE)
    return {r.doc_id: r for r in reconcile.reconcile(df).collect()}


def rules_of(r):
    return {x.rule for x in r.repairs}


def failed(r):
    return {x.constraint for x in r.violations}


FULL = {**HEADER, "totals": {"net": "100.00", "tax": "19.00", "gross": "119.00"}, "vat_breakdown": [{"rate": 19.0, "net": "100.00", "tax": "19.00"}], "line_items": [ITEM | {"quantity": "4", "unit_price": "25", "tax_rate": 19.0, "line_total": "100.00"}]}


def test_a_full_invoice_needs_no_repair(solved):
    r = solved["full"]
    assert (r.status, r.repairs, r.violations, r.total_failure) == ("reconciled", [], [], False)
    assert r.invoice.currency == "EUR" and r.invoice.line_items[0].quantity == "4" and r.invoice.totals.gross == "119.00"


ERASED = {
    "R_TOTALS_FROM_VAT": {"totals": {"net": None, "tax": None, "gross": "119.00"}},
    "R_NET_FROM_LINES": {"totals": {"net": None, "tax": "19.00", "gross": None}, "vat_breakdown": [{"rate": 19.0, "net": None, "tax": "19.00"}]},
    "R_TOTAL_DERIVE": {"totals": {"net": "100.00", "tax": "19.00", "gross": None}},
    "R_VAT_SYNTH": {"vat_breakdown": []},
    "R_LINETOTAL_DERIVE": {"line_items": [FULL["line_items"][0] | {"line_total": None}]},
    "R_UNITPRICE_DERIVE": {"line_items": [FULL["line_items"][0] | {"unit_price": None}]},
    "R_QTY_DERIVE": {"line_items": [FULL["line_items"][0] | {"quantity": None}]},
    "R_QTY_DEFAULT": {"line_items": [FULL["line_items"][0] | {"quantity": None, "unit_price": None}]},
    "R_LINE_TAX_INHERIT": {"line_items": [FULL["line_items"][0] | {"tax_rate": None}]},
}


@pytest.mark.parametrize("rule", ERASED)
def test_each_rule_restores_what_was_erased(solved, rule):
    r = solved[rule]
    assert r.status == "reconciled" and rule in rules_of(r) and rule not in rules_of(solved["full"])
    assert r.invoice.totals.asDict() == FULL["totals"] and r.invoice.line_items[0].line_total == "100.00"
    assert {p for p in r.derived} == {x.path for x in r.repairs} and r.derived[r.repairs[0].path].confidence == pytest.approx(0.585)


BROKEN = {
    "C1_TOTALS": {"totals": {"net": "100.00", "tax": "19.00", "gross": "140.50"}},
    "C2_LINE_SUM": {"line_items": [FULL["line_items"][0] | {"quantity": "1", "unit_price": "119", "line_total": "119.00"}]},
    "C3_LINE_MATH": {"line_items": [FULL["line_items"][0] | {"quantity": "3"}]},
    "C4_VAT_SUM": {"vat_breakdown": [{"rate": 19.0, "net": "90.00", "tax": "17.10"}]},
    "C5_VAT_CLOSED_SET": {"vat_breakdown": [{"rate": 16.0, "net": "100.00", "tax": "16.00"}]},
    "LINE_TOTAL_UNRESOLVED": {"line_items": [ITEM]},
    "LINE_TAX_UNRESOLVED": {"vat_breakdown": [{"rate": 19.0, "net": "50.00", "tax": "9.50"}, {"rate": 7.0, "net": "50.00", "tax": "3.50"}], "line_items": [FULL["line_items"][0] | {"tax_rate": None}]},
    "REQUIRED_MISSING": {"invoice_number": " "},
    "TOTALS_INCOMPLETE": {"totals": None, "vat_breakdown": [], "line_items": [ITEM]},
    "VAT_MISSING": {"vat_breakdown": [], "totals": {"net": "100.00", "tax": "5.00", "gross": "105.00"}},
    "VAT_INCOMPLETE": {"vat_breakdown": [{"rate": None, "net": "100.00", "tax": "19.00"}]},
    "LINE_ITEMS_MISSING": {"line_items": []},
    "SCHEMA_INVALID": {"issue_date": "31.01.2026"},
}


@pytest.mark.parametrize("constraint", BROKEN)
def test_each_violation(solved, constraint):
    r = solved[constraint]
    assert r.status == "failed" and constraint in failed(r) and r.invoice is None


def test_details_of_violations(solved):
    r = solved["C1_TOTALS"]
    assert [(v.constraint, v.delta) for v in r.violations] == [("C1_TOTALS", "-21.50")]
    hint = [v.hint for v in solved["C2_LINE_SUM"].violations if v.constraint == "C2_LINE_SUM"]
    assert hint == ["lines_may_be_gross"]
    assert solved["day"].status == "reconciled"


def test_zero_rate_is_apportioned_from_the_header(solved):
    r = solved["zero"]
    assert r.status == "reconciled" and r.invoice.vat_breakdown[0].net == "1000.00"


def test_total_failure_is_judged_before_repairs(solved):
    assert solved["bad"].total_failure and not solved["bare"].total_failure


def rule_result(spark, *texts, tables=()):
    return one(document(spark, [line(t, 0.05 + 0.05 * i) for i, t in enumerate(texts)], tables), rules.run_rules(F.col("lines"), F.col("tables")))


def test_rules(spark):
    pages = (
        ("Rechnungs-Nr.: RE/2026/17", "Datum 05.03.2026", "Nettobetrag 1.148,70 zzgl. 19% MwSt", "MwSt. 19%: 218,25", "USt-IdNr. DE136695976", "Zwischensumme (netto) 5,00", "Gesamtbetrag 1.366,95 EUR, nicht $"),
        ("Rechnung 15.06.2026",),
        ("Netto 5,00", "Zwischensumme 7,00"),
        ("MwSt 19 % 0,00", "MwSt 2,5 % 14,00"),
    )
    docs = None
    for n, texts in enumerate(pages):
        own = document(spark, [line(t, 0.05 + 0.05 * i) for i, t in enumerate(texts)], doc_id=str(n))
        docs = own if docs is None else docs.unionAll(own)
    r, bare, longest, twice = [x.v for x in docs.select("doc_id", rules.run_rules(F.col("lines"), F.col("tables")).alias("v")).orderBy("doc_id").collect()]
    assert (r.invoice_number.value, r.issue_date.value, r.net.value, r.tax.value, r.gross) == ("RE/2026/17", "2026-03-05", "19", "218.25", None)
    assert [(v.rate, v.tax) for v in r.vat] == [(19.0, "218.25")] and r.currency == "EUR"
    assert set(r.missed) == {"due_date", "gross", "line_items"} and "vat_breakdown" in r.found
    assert bare.invoice_number.value == "15.06.2026"
    assert longest.net.value == "7.00"
    assert [v.rate for v in twice.vat] == [19.0]


def test_columns_and_items(spark):
    head = ["Pos", "Bezeichnung", "Menge", "Einzelpreis", "Steuersatz", "Gesamt"]
    rows = [["", "Kopf", "", "", "", ""], ["01", "Papier", "2", "1,50", "19%", "3,00"], ["", "weiß", "", "", "", ""], ["2.", "", "1", "", "", "9,00"], ["3", "Stift", "4", "0,25", "19,5%"]]
    r = rule_result(spark, "x", tables=[(["Datum"], [["x"]]), (head, rows)])
    assert [(i.position, i.description, i.quantity, i.unit_price, i.tax_rate, i.line_total) for i in r.items] == [(None, "Kopf", None, None, None, None), (1, "Papier weiß", "2", "1.50", 19.0, "3.00"), (3, "Stift", "4", "0.25", 19.5, None)]
    t = spark.createDataFrame([(["Beschreibung", "Steuersatz"],), (["Menge", "Betrag"],)], "h array<string>")
    got = [x.v for x in t.select(rules.classify_columns(F.col("h")).alias("v")).collect()]
    assert got[0][line_items.COLUMNS.index("unit_price")] == 1 and got[1] is None


def test_gate(spark):
    texts = ["the invoice and the payment are due within this month for our customer", "xkcdq wrtzp qwrtz plkmn bvcxy nmbvc hgfds trewq zuiop lkjhg", "", "1 2 3", "a b c d e f g h i j k l", "(cid:12) the total amount", "one word"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.g for r in df.select("i", gate.text_gate(F.col("t")).alias("g")).orderBy("i").collect()]
    assert [g.verdict for g in got] == ["ok", "garbage", "ok", "ok", "garbage", "garbage", "ok"]
    assert got[1].hit_rate == 0 and got[2].hit_rate is None and got[5].cid_tokens == 1


def test_classifier(spark):
    lines = [line("Rechnung", 0.1), line("Rechnungsnummer R-2026-1"), line("Rechnungsdatum 01.02.2026"), line("USt-IdNr. DE811907980"), line("MwSt 19 % 3,00")]
    df = document(spark, lines, [(["a", "b"], [["x", "1,00"], ["y", "2,00 EUR"], ["z", "nein"]])])
    c = one(df, classify.classify(F.col("lines"), F.col("tables")))
    assert c.score == 12 and c.band == "invoice" and set(c.features.values()) == {1}
    assert one(document(spark, [line("Rechnung", 0.25), line("Brief")]), classify.classify(F.col("lines"), F.col("tables"))).score == 0
    few = options.Classify(weights={"heading_keyword": 5})
    assert one(df, classify.classify(F.col("lines"), F.col("tables"), few)).band == "uncertain"


def test_markdown(spark):
    df = document(spark, [line("Titel", tag="title"), line("eins"), line("zwei", page=2)], [(["a|b", "c"], [["1", "2"]])], pages=2)
    assert one(df, classify.markdown(F.col("lines"), F.col("tables"))) == "## Titel\neins\n\n---\n\nzwei\n\n| a|b | c |\n| --- | --- |\n| 1 | 2 |"


def test_segments(spark):
    def kinds(lines, pages):
        s = one(document(spark, lines, pages=pages), segment.segments(segment.page_features(F.col("lines"), F.col("page_count"))))
        return [(x.kind[:3], x.pages) for x in s]

    assert kinds([], 0) == [("inv", [])]
    assert kinds([line("Rechnung"), line("Seite 1 von 2", page=2)], 2) == [("inv", [1]), ("inv", [2])]
    assert kinds([line("Rechnung"), line("Rechnung", page=2)], 2) == [("inv", [1, 2])]
    assert kinds([line("Rechnung"), line("Zu zahlen 5,00", 0.9), line("Rechnung", page=2)], 2) == [("inv", [1]), ("inv", [2])]
    assert kinds([line("Rechnung"), line("Unsere AGB", page=2), line("weiter", page=3)], 3) == [("inv", [1]), ("att", [2]), ("inv", [3])]
    cut = one(document(spark, [line("a"), line("b", page=3)], pages=3), segment.slice_lines(F.col("lines"), F.array(F.lit(3))))
    assert [(x.text, x.page, x.tokens[0].page) for x in cut] == [("b", 1, 1)]


def test_merged_lines(spark):
    words = [line("b", 0.100, x=0.5), line("a", 0.102, x=0.1), line("c", 0.2), line("d", 0.207), line("e", 0.214), line("f", 0.3, tag="title")]
    got = one(document(spark, words), layout.merged_lines(F.col("lines")))
    assert [(x.text, len(x.tokens), x.tag) for x in got] == [("a b", 2, None), ("c d e", 3, None), ("f", 1, "title")]
    rows = [(1, 1, i, w["text"], *w["box"].values(), w["tag"]) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id int, page int, ix int, text string, x0 double, y0 double, x1 double, y1 double, tag string")
    assert [r.text for r in layout.merge_lines(df).orderBy("line").collect()] == ["a b", "c d e", "f"]


def test_layout_json(spark):
    box = {"l": 59.5276, "t": 800, "r": 300, "b": 790, "coord_origin": "BOTTOMLEFT"}
    cells = [{"text": "Pos", "column_header": True, "start_col_offset_idx": 0, "end_col_offset_idx": 1}, {"text": "Wort", "column_header": True, "start_col_offset_idx": 1, "end_col_offset_idx": 3}, {"text": "1", "start_row_offset_idx": 1, "end_row_offset_idx": 2, "start_col_offset_idx": 0, "end_col_offset_idx": 1}, {"text": "x", "start_row_offset_idx": 1, "end_row_offset_idx": 2, "start_col_offset_idx": 2, "end_col_offset_idx": 3}]
    whole = {"texts": [{"label": "text", "text": " b ", "prov": [{"page_no": 1, "bbox": box | {"t": 700}}]}, {"orig": "a", "prov": [{"page_no": 1, "bbox": box}]}, {"text": "lost"}, {"text": " ", "prov": [{"page_no": 1, "bbox": box}]}], "tables": [{"prov": [{"page_no": 1, "bbox": box}], "data": {"num_rows": 2, "num_cols": 3, "table_cells": cells}}], "pages": {"1": {"page_no": 1}, "2": {"page_no": 2}}}
    wide = {"texts": [{"text": "a", "prov": [{"page_no": 1, "bbox": box | {"r": 900}}]}]}
    df = spark.createDataFrame([(1, json.dumps(whole)), (2, json.dumps(wide)), (3, "{}")], "doc_id int, layout_json string")
    a, b, c = ports.read_layout(df).orderBy("doc_id").collect()
    assert a.page_count == 2 and [x.text for x in a.lines] == ["a", "b"] and a.error is None
    assert a.lines[0].box.x0 == pytest.approx(0.1) and a.lines[0].box.y0 == pytest.approx((841.89 - 800) / 841.89)
    assert a.tables[0].header == ["Pos", "Wort", "Wort"] and a.tables[0].rows == [["1", "", "x"]]
    assert b.error and c.lines == [] and c.page_count == 1 and c.error is None


def test_bands(spark):
    starts = F.array(F.lit(0.125), F.lit(0.375), F.lit(0.75))
    df = spark.createDataFrame([(0.0, 0.0625), (0.25, 0.5), (0.3125, 0.4375), (0.6875, 0.9375), (0.5, 0.5), (0.0, 0.0)], "a double, b double")
    assert [r.v for r in df.select(layout.band_of(F.col("a"), F.col("b"), starts).alias("v")).collect()] == [0, 1, 1, 2, 1, 0]


def test_merge(spark):
    def envelope(**given):
        return invoice(**given)

    p = envelope(invoice_number="p", totals={"net": "1", "tax": None, "gross": None}, buyer={"name": "b", "customer_number": None, "address": None}, line_items=[])
    s = envelope(invoice_number="s", issue_date="2026-01-01", totals={"net": "2", "tax": "3", "gross": None}, buyer={"name": "c", "customer_number": "9", "address": None}, line_items=[ITEM])
    df = spark.createDataFrame([(p, s)], f"p {schemas.INVOICE}, s {schemas.INVOICE}")
    m = one(df, merge.merge_invoices(F.col("p"), F.col("s")))
    assert (m.invoice_number, m.issue_date, m.totals.net, m.totals.tax, m.buyer.customer_number, len(m.line_items), m.seller) == ("p", "2026-01-01", "1", "3", None, 1, None)


def xml_rows(spark, *xml):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "i int, xml string")
    return cii.read_xml(df).orderBy("i").collect()


def test_e_invoice(spark):
    item = "<ram:IncludedSupplyChainTradeLineItem><ram:AssociatedDocumentLineDocument><ram:LineID>1</ram:LineID><ram:IncludedNote><ram:Content>Note</ram:Content></ram:IncludedNote></ram:AssociatedDocumentLineDocument><ram:SpecifiedLineTradeAgreement><ram:GrossPriceProductTradePrice><ram:ChargeAmount>2.50</ram:ChargeAmount></ram:GrossPriceProductTradePrice></ram:SpecifiedLineTradeAgreement><ram:SpecifiedLineTradeDelivery><ram:BilledQuantity unitCode='C62'>4</ram:BilledQuantity></ram:SpecifiedLineTradeDelivery></ram:IncludedSupplyChainTradeLineItem>"
    good = CII % ("R-1", "20260131", item, 1, "811 907 980", "10.00", "10.00", "<ram:TaxTotalAmount>1.9e1</ram:TaxTotalAmount>", "-10.00")
    a, b, c, d = xml_rows(spark, good, good[:300], "", "<x/>")
    i = a.invoice
    assert (i.invoice_number, i.issue_date, i.seller.vat_id, i.totals.net, i.totals.tax, i.totals.gross, i.currency) == ("R-1", "2026-01-31", "DE811907980", "10.00", None, "-10.00", "EUR")
    x = i.line_items[0]
    assert (x.position, x.description, x.quantity, x.unit, x.unit_price, x.line_total) == (1, "Note", "4", "C62", "2.50", None)
    assert a.error is None and all(r.error and r.invoice is None for r in (b, c, d))


def test_vendor_tiers(spark):
    ids = "struct<vat_id:string,tax_number:string,ibans:array<string>,name_hash:string>"
    t = spark.createDataFrame([("1", ("V1", None, ["I"], "n")), ("2", (None, "T2", ["I"], "n")), ("3", ("V3", None, [], "m"))], f"template_id string, ids {ids}")
    d = spark.createDataFrame([(1, ("V3", "T2", ["I"], None)), (2, (None, "T2", [], "m")), (3, ("V9", None, ["I"], None)), (4, (None, None, None, "m")), (5, ("", None, None, None))], f"doc_id int, ids {ids}")
    got = {r.doc_id: (r.template_id, r.matched_by) for r in vendors.resolve(d, t).collect()}
    assert got == {1: ("3", "vat_id"), 2: ("2", "tax_number"), 3: ("1", "iban"), 4: ("3", "name_hash"), 5: (None, None)}


def test_upsert_keeps_vendors_apart(spark):
    ids = "struct<vat_id:string,tax_number:string,ibans:array<string>,name_hash:string>"
    t = spark.createDataFrame([("1", ("V1", None, ["I"], None), "old", 3, "vlm")], f"template_id string, ids {ids}, body string, version int, source string")
    rows = [(1, 1, ("V1", None, ["J"], "h"), "a", "vlm"), (2, 2, ("V1", None, ["I"], None), "b", "rule_engine"), (3, 3, ("V2", None, ["I"], None), "c", "vlm"), (4, 4, (None, None, ["I"], None), "d", "vlm")]
    got = {r.template_id: r for r in vendors.upsert(t, spark.createDataFrame(rows, f"doc_id int, seq int, ids {ids}, body string, source string")).collect()}
    assert set(got) == {"1", "new:0:V2"}
    assert (got["1"].version, got["1"].body, sorted(got["1"].ids.ibans), got["1"].ids.name_hash) == (6, "d", ["I", "J"], "h")
    assert (got["new:0:V2"].version, got["new:0:V2"].body) == (1, "c")


def test_parameters():
    assert records.checked_limit(None) == 100 and records.checked_limit("500") == 500
    for bad in ("0", "501", "1.5", "x"):
        with pytest.raises(ValueError):
            records.checked_limit(bad)
    with pytest.raises(ValueError):
        records.checked_id("no-uuid")


def test_options(tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"reconcile": {"passes": 2, "vat_rates": [20, 0]}, "model_enabled": True}))
    made = options.read_options(str(path), {"PAPERLEDGER_MOST_ATTEMPTS": "7"})
    assert made.reconcile.passes == 2 and made.reconcile.vat_rates == ("20", "0") and made.model_enabled and made.most_attempts == 7
    path.write_text('{"x": 1}')
    with pytest.raises(ValueError):
        options.read_options(str(path), {})


def test_ports(spark, tmp_path):
    names = spark.createDataFrame([("Factur-X.xml",), ("my-zugferd-1.xml.bak",), ("a.pdf",)], "n string")
    assert [r.v for r in names.select(ports.is_invoice_attachment(F.col("n")).alias("v")).collect()] == [True, True, False]
    replies = spark.createDataFrame([(1, '```json\n{"is_invoice": false, "markdown": "m"}\n```'), (2, "no")], "doc_id int, reply string")
    port = ports.retried(ports.table_port(spark, replies))
    got = {r.doc_id: (r.is_invoice, r.not_json) for r in port(replies.select("doc_id")).collect()}
    assert got == {1: (False, False), 2: (None, True)}
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"")
    files = ports.read_files(spark, str(tmp_path)).collect()
    assert [(f.filename, f.content_hash[:6]) for f in files] == [("a.pdf", "2d7116")]
    s = json.loads(schemas.json_schema_text(schemas.CANONICAL))
    assert s["required"][0] == "schema_version" and s["properties"]["totals"]["required"] == ["net", "tax", "gross"]
