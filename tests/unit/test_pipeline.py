"""The golden scenario through the batch plan, a scan of it, and the stream."""

import json

from pyspark.sql import functions as F

from paperledger.operators import layout, template
from paperledger.plans import options, pipeline, schemas
from paperledger.queries.records import CII
from paperledger.sources import ports
from paperledger.sources.tables import materialised
from paperledger.streaming import pipeline as streaming
from tests.unit.test_operators import document, line, one


def scenario():
    """A one-rate invoice of three items, one with a wrapped description."""
    texts = ["ACME Buerotechnik GmbH", "Rechnung", "Rechnungsnummer: R-2026-0042", "Rechnungsdatum: 15.06.2026", "for the delivery of this order please note the payment terms of the contract", "Nettobetrag: 1.148,70", "MwSt 19 %: 218,25", "Gesamtbetrag: 1.366,95", "USt-IdNr. DE811907980", "IBAN DE02 1203 0000 0000 2020 51 in EUR"]
    lines = [line(t, 0.02 + 0.06 * i) for i, t in enumerate(texts)]
    head = ["Pos", "Bezeichnung", "Menge", "Einzelpreis", "Gesamtpreis"]
    rows = [["1", "Aktenvernichter", "1", "399,00", "399,00"], ["", "mit Korb", "", "", ""], ["2", "Toner", "3", "199,50", "598,50"], ["3", "Papier", "4", "37,80", "151,20"]]
    return lines, [(head, rows)]


def test_golden_invoice_is_committed_and_teaches_a_template(spark):
    lines, tables = scenario()
    docs = document(spark, lines, tables, doc_id="a").unionAll(document(spark, [line("Dear customer, thank you for your letter and the information about this month"), line("we shall contact you before the end of the week with regard to your order")], doc_id="b"))
    none = spark.createDataFrame([], streaming.TEMPLATES)
    first = pipeline.run_batch(docs, none)
    first.templates = materialised(first.templates, "templates")
    got = {r.doc_id: r for r in first.documents.collect()}
    assert got["a"].status == "committed" and got["b"].status == "exported_markdown"
    i = got["a"].canonical
    assert (i.invoice_number, i.issue_date, i.totals.net, i.totals.gross, i.seller.name) == ("R-2026-0042", "2026-06-15", "1148.70", "1366.95", "ACME Buerotechnik GmbH")
    assert [x.description for x in i.line_items] == ["Aktenvernichter mit Korb", "Toner", "Papier"] and {x.tax_rate for x in i.line_items} == {19.0}
    (t,) = first.templates.collect()
    assert t.version == 1 and t.source == "rule_engine" and t.ids.vat_id == "DE811907980" and t.body.decimal == ","
    assert t.body.fields["invoice_number"].value_pattern == r"R-\d+-\d+" and t.body.fields["gross"].label == "Gesamtbetrag"
    assert t.body.item_table.columns == {"description": 1, "line_total": 4, "unit_price": 3, "quantity": 2, "position": 0}
    # The next document of this vendor is read by that template.
    again = document(spark, [x | {"text": x["text"].replace("0042", "0077").replace("15.06", "16.06")} for x in lines], tables, doc_id="c")
    known = first.templates.withColumn("template", F.col("body"))
    laned = materialised(pipeline.text_lane(again, options.Options()), "again")
    out = pipeline.extract(laned, known).first()
    assert out.matched_by == "vat_id" and out.invoice.invoice_number == "R-2026-0077" and out.field_meta["invoiceNumber"].source == "template" and out.field_meta["invoiceNumber"].confidence == 0.95


def test_scan_by_template(spark):
    lines, tables = scenario()
    t = pipeline.run_batch(document(spark, lines, tables, doc_id="a"), spark.createDataFrame([], streaming.TEMPLATES)).templates
    t = materialised(t.select(F.col("body").alias("t")), "one")
    words = []
    for x in lines:
        parts = x["text"].split()
        words += [line(w, x["box"]["y0"], x=0.1 + 0.08 * k, w=0.07) for k, w in enumerate(parts)]
    starts = [0.1, 0.2, 0.5, 0.65, 0.8]
    grid = [tables[0][0], *tables[0][1], ["", "Summe", "", "", "1.148,70"]]
    words += [line(c, 0.7 + 0.02 * r, x=starts[k] - (0.02 if k > 1 and r else 0), w=0.09) for r, row in enumerate(grid) for k, c in enumerate(row) if c]
    df = document(spark, words, doc_id="s").withColumn("k", F.lit(1)).join(t.withColumn("k", F.lit(1)), "k").withColumn("merged", layout.merged_lines(F.col("lines")))
    a = one(df, template.apply_template_ocr(F.col("t"), F.col("merged"), F.col("page_count")))
    assert a.row_source == "ocr" and [(x.description, x.quantity, x.line_total) for x in a["items"]] == [("Aktenvernichter mit Korb", "1", "399.00"), ("Toner", "3", "598.50"), ("Papier", "4", "151.20")]
    induced = one(document(spark, words), template.induce_ocr_table(layout.merged_lines(F.col("lines"))))
    assert induced.header == tables[0][0] and induced.columns["line_total"] == 4


def test_stream(spark, tmp_path):
    lines, tables = scenario()
    source = str(tmp_path / "in")
    document(spark, lines, tables, doc_id="a").write.parquet(source)
    stream = spark.readStream.schema(schemas.POSITIONED).parquet(source)
    run = streaming.start(stream, str(tmp_path / "out"))
    run.awaitTermination(300)
    assert streaming.health(run, str(tmp_path / "out"), layout=False) == {"ok": True, "store": True, "worker": True, "layout": False}
    assert not streaming.health(run, str(tmp_path / "nowhere"))["ok"]
    assert spark.read.parquet(str(tmp_path / "out/events/v=0")).where("event = 'reconciled'").count() == 1
    assert [r.status for r in spark.read.parquet(str(tmp_path / "out/documents/v=0")).collect()] == ["committed"]
    assert streaming.templates_before(spark, str(tmp_path / "out"), 1).count() == 1


def test_invoices_of_one_document_are_each_extracted(spark):
    lines, tables = scenario()
    second = [x | {"text": x["text"].replace("0042", "0077"), "page": 2} for x in lines]
    df = document(spark, lines + second, tables * 2, doc_id="two")
    at = F.transform("tables", lambda t, i: t.withField("page", (i + 1).cast("int")))
    docs = df.withColumns({"tables": at, "page_count": F.lit(2)}).unionByName(document(spark, lines, tables, doc_id="a"))
    rows = pipeline.run_batch(docs, spark.createDataFrame([], streaming.TEMPLATES)).documents.collect()
    assert {r.doc_id: (r.status, r.parent_id) for r in rows if r.parent_id is None} == {"two": ("segmented", None), "a": ("committed", None)}
    parts = {r.canonical.invoice_number: r for r in rows if r.parent_id == "two"}
    assert len(rows) == 4 and sorted(parts) == ["R-2026-0042", "R-2026-0077"]
    for r in parts.values():
        assert r.status == "committed" and r.canonical.totals.gross == "1366.95"
        assert [x.description for x in r.canonical.line_items] == ["Aktenvernichter mit Korb", "Toner", "Papier"]


def test_every_lane(spark):
    """E-invoices, one of them broken, scans for the model, and texts, each to its end."""
    lines, tables = scenario()
    item = "<ram:IncludedSupplyChainTradeLineItem><ram:AssociatedDocumentLineDocument><ram:LineID>1</ram:LineID></ram:AssociatedDocumentLineDocument><ram:SpecifiedTradeProduct><ram:Name>Ware</ram:Name></ram:SpecifiedTradeProduct><ram:SpecifiedLineTradeSettlement><ram:ApplicableTradeTax><ram:RateApplicablePercent>0</ram:RateApplicablePercent></ram:ApplicableTradeTax><ram:SpecifiedTradeSettlementLineMonetarySummation><ram:LineTotalAmount>10.00</ram:LineTotalAmount></ram:SpecifiedTradeSettlementLineMonetarySummation></ram:SpecifiedLineTradeSettlement></ram:IncludedSupplyChainTradeLineItem>"
    xml = CII % ("Z-1", "20260615", item, "1", "811907980", "10.00", "10.00", '<ram:TaxTotalAmount currencyID="EUR">0.00</ram:TaxTotalAmount>', "10.00")
    whole = [document(spark, lines, tables, doc_id=x) for x in ("z1", "z2")]
    letter = document(spark, [line("Dear customer, thank you for your letter and the information about this month"), line("we shall contact you before the end of the week with regard to your order")], doc_id="t1")
    none = [document(spark, [], doc_id=x) for x in ("s1", "s2")]
    docs = whole[0].unionAll(whole[1]).unionAll(letter).unionAll(none[0]).unionAll(none[1])

    def attached(content):
        return F.array(F.struct(F.lit("factur-x.xml").alias("name"), F.lit(content).cast("binary").alias("content")))

    empty = F.array().cast("array<struct<name:string,content:binary>>")
    docs = docs.withColumns({"attachments": F.when(F.col("doc_id") == "z1", attached(xml)).when(F.col("doc_id") == "z2", attached(xml[:200])).otherwise(empty), "characters": F.when(F.col("doc_id").isin("s1", "s2"), 0).otherwise(900)})
    entry = {"rate": 19.0, "net": "100.00", "tax": "19.00"}
    invoice = {"schema_version": 1, "invoice_number": "M-1", "issue_date": "2026-06-15", "currency": "EUR", "seller": {"name": "ACME", "ibans": []}, "totals": {"net": "100.00", "tax": "19.00", "gross": "119.00"}, "vat_breakdown": [entry], "line_items": [{"position": 1, "description": "Ware", "tax_rate": 19.0, "line_total": "100.00"}]}
    replies = spark.createDataFrame([("s1", "```json\n" + json.dumps({"is_invoice": True, "invoice": invoice, "markdown": None}) + "\n```"), ("s2", json.dumps({"is_invoice": False, "invoice": None, "markdown": "# A letter"}))], "doc_id string, reply string")
    words = document(spark, [line("Some words of a scan", 0.1)], doc_id="s1").select("lines", "tables", "page_count")
    outside = pipeline.Ports(ocr=lambda d: d.select("doc_id").crossJoin(F.broadcast(words)), model=ports.retried(lambda d: d.select("doc_id").join(replies, "doc_id")))
    r = pipeline.run_batch(docs, spark.createDataFrame([], streaming.TEMPLATES), options.Options(model_enabled=True), ports=outside)
    got = {x.doc_id: x for x in materialised(r.documents, "all").collect()}
    assert {k: x.status for k, x in got.items()} == {"z1": "committed", "z2": "committed", "t1": "exported_markdown", "s1": "committed", "s2": "exported_markdown"}
    assert got["z1"].canonical.invoice_number == "Z-1" and got["z2"].canonical.invoice_number == "R-2026-0042" and got["s1"].canonical.invoice_number == "M-1" and got["s2"].markdown == "# A letter"
    assert {(x.doc_id, x.reason) for x in r.escalations.collect()} == {("z2", "xml_fallthrough"), ("s1", "to_model"), ("s2", "to_model")}
    hops = {x.doc_id: x.detail for x in r.events.where("event = 'routed'").collect()}
    assert hops["z1"] == '{"route":"zugferd"}' and hops["s1"] == '{"route":"image"}' and hops["t1"] == '{"route":"text"}'
