"""Vendors, stored rows, traces and e-invoices, over suppliers, orders, events and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cii as X
from ..operators import classify as C
from ..operators import merge as M
from ..operators import records as R
from ..operators import vendors as V
from ..plans.schemas import INVOICE, VIOLATION, struct_type
from . import query, read, spread
from .texts import AMOUNT_SQL, PAGE_SQL, pages

IDS = "struct<vat_id:string,tax_number:string,ibans:array<string>,name_hash:string>"


def _ids(vat, tax, ibans, name) -> Column:
    return F.struct(vat.alias("vat_id"), tax.alias("tax_number"), ibans.alias("ibans"), name.alias("name_hash")).cast(IDS)


def _said(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def vendor_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each supplier; even ones have a VAT id, every third a tax number, and accounts are shared."""
    k = F.col("s_suppkey")
    ids = _ids(F.when(k % 2 == 0, _said("V", k)), F.when(k % 3 == 0, _said("T", k)), F.array(_said("I", k % 40)), _said("N", F.col("s_nationkey")))
    return read(spark, sf_dir, "supplier").select(k.alias("template_id"), ids.alias("ids"), _said("body ", k).alias("body"), F.lit(1).alias("version"), F.lit("rule_engine").alias("source"))


@query("""WITH t AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'V' || s_suppkey END AS vat, CASE WHEN s_suppkey % 3 = 0 THEN 'T' || s_suppkey END AS tax, 'I' || (s_suppkey % 40) AS iban, 'N' || s_nationkey AS name FROM supplier),
d AS (SELECT o_orderkey AS doc_id, 'V' || (o_orderkey % 150) AS vat, CASE WHEN o_orderkey % 2 = 0 THEN 'T' || (o_orderkey % 170) END AS tax, 'I' || (o_orderkey % 60) AS iban, 'N' || (o_orderkey % 30) AS name FROM orders),
a AS (SELECT d.doc_id, (SELECT min(id) FROM t WHERE t.vat = d.vat) AS v, (SELECT min(id) FROM t WHERE t.tax = d.tax) AS x, (SELECT min(id) FROM t WHERE t.iban = d.iban) AS i, (SELECT min(id) FROM t WHERE t.name = d.name) AS n FROM d)
SELECT doc_id, coalesce(v, x, i, n) AS template_id, CASE WHEN v IS NOT NULL THEN 'vat_id' WHEN x IS NOT NULL THEN 'tax_number' WHEN i IS NOT NULL THEN 'iban' WHEN n IS NOT NULL THEN 'name_hash' END AS matched_by FROM a""")
def vendor_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ids = _ids(_said("V", k % 150), F.when(k % 2 == 0, _said("T", k % 170)), F.array(_said("I", k % 60)), _said("N", k % 30))
    docs = read(spark, sf_dir, "orders").select(k.alias("doc_id"), ids.alias("ids"))
    return V.resolve(docs, vendor_templates(spark, sf_dir)).drop("ids")


@query("""WITH t AS (SELECT s_suppkey AS id FROM supplier), m AS (SELECT o_orderkey AS k, (o_orderkey % 300) AS v FROM orders),
g AS (SELECT v, count(*) AS n, count(DISTINCT k % 7) AS accounts, max_by('order ' || k, k) AS body FROM m GROUP BY v)
SELECT coalesce(CAST(t.id AS VARCHAR), 'new:0:V' || g.v) AS template_id, CAST(CASE WHEN t.id IS NULL THEN g.n ELSE 1 + coalesce(g.n, 0) END AS INTEGER) AS version,
 coalesce(g.body, 'body ' || t.id) AS body, CASE WHEN g.v IS NULL THEN 'rule_engine' ELSE 'vlm' END AS source, CAST(CASE WHEN t.id IS NULL THEN g.accounts WHEN g.v IS NULL THEN 1 ELSE 1 + g.accounts END AS INTEGER) AS accounts
 FROM t FULL OUTER JOIN g ON t.id = g.v AND t.id % 2 = 0""")
def vendor_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders induce templates under VAT ids; some meet a stored one, which grows, and some are new."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    ids = _ids(_said("V", k % 300), none, F.array(_said("J", k % 7)), none)
    induced = read(spark, sf_dir, "orders").select(k.alias("doc_id"), k.alias("seq"), ids.alias("ids"), _said("order ", k).alias("body"), F.lit("vlm").alias("source"))
    done = V.upsert(vendor_templates(spark, sf_dir), induced)
    return done.select("template_id", "version", "body", "source", F.size("ids.ibans").alias("accounts"))


@query("""SELECT 'I' || (o_custkey % 500) AS iban, min_by(o_orderkey % 20, o_orderkey) AS template_id FROM orders WHERE o_custkey % 500 % 5 <> 0 GROUP BY 1""")
def iban_first_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts divisible by 5 are claimed already."""
    o = read(spark, sf_dir, "orders")
    links = o.select(_said("I", F.col("o_custkey") % 500).alias("iban"), (F.col("o_orderkey") % 20).alias("template_id"), F.col("o_orderkey").alias("seq"))
    held = spark.range(0, 500, 5).select(_said("I", F.col("id")).alias("iban"))
    return V.unclaimed(links, held)


@query("""WITH d AS (SELECT doc_id, lang, sha256(encode(text)) AS content_hash FROM documents), h AS (SELECT content_hash FROM d WHERE lang = 'en' AND doc_id % 10 <> 0)
SELECT content_hash, min(doc_id) AS doc_id FROM d WHERE lang <> 'en' AND content_hash NOT IN (SELECT content_hash FROM h) GROUP BY content_hash""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents: the English ones are the history, of which those divisible by 10 failed; the rest comes in."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", R.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))
    history = d.where("lang = 'en'").withColumn("status", F.when(F.col("doc_id") % 10 == 0, "failed").otherwise("committed"))
    return R.fresh(d.where("lang <> 'en'"), history).select("content_hash", "doc_id")


def _candidate(k: Column, tag: str, m: int) -> Column:
    """A candidate invoice of an order with fields present by the key's remainders."""
    def some(n: int, value: Column) -> Column:
        return F.when(k % (n + m) != 0, value)

    values = {
        "invoice_number": some(2, _said(f"{tag}-", k)),
        "issue_date": some(3, F.lit(f"2024-0{m}-01")),
        "totals": F.when(k % (5 + m) != 0, F.struct(some(2, F.lit(f"{m}.00")).alias("net"), some(4, F.lit(f"{m}.10")).alias("tax"), F.lit(None).cast("string").alias("gross"))),
        "seller": F.when(k % (4 + m) != 0, F.struct(some(3, F.lit(tag)).alias("name"), F.lit(None).cast("string").alias("vat_id"), some(2, F.lit(f"T{m}")).alias("tax_number"), F.when(k % (3 + m) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(f"I{m}"))).alias("ibans"), F.lit(None).alias("address"))),
        "vat_breakdown": F.when(k % (6 + m) == 0, F.array()).otherwise(F.array(F.struct(F.lit(float(m)).alias("rate"), F.lit("1.00").alias("net"), F.lit("0.19").alias("tax")))),
    }
    fields = [f.name for f in struct_type(INVOICE).fields]
    kinds = {f.name: f.dataType for f in struct_type(INVOICE).fields}
    return F.struct(*[values.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in fields])


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders),
c AS (SELECT k, CASE WHEN k % 3 <> 0 THEN 'p-' || k END AS n1, CASE WHEN k % 4 <> 0 THEN 's-' || k END AS n2, CASE WHEN k % 4 <> 0 THEN '2024-01-01' END AS d1, CASE WHEN k % 5 <> 0 THEN '2024-02-01' END AS d2,
 k % 6 <> 0 AS t1, k % 7 <> 0 AS t2, k % 5 <> 0 AS s1, k % 6 <> 0 AS s2 FROM o)
SELECT k, coalesce(n1, n2) AS invoice_number, coalesce(d1, d2) AS issue_date,
 coalesce(CASE WHEN t1 AND k % 3 <> 0 THEN '1.00' END, CASE WHEN t2 AND k % 4 <> 0 THEN '2.00' END) AS net, coalesce(CASE WHEN t1 AND k % 5 <> 0 THEN '1.10' END, CASE WHEN t2 AND k % 6 <> 0 THEN '2.10' END) AS tax,
 coalesce(CASE WHEN s1 AND k % 4 <> 0 THEN 'p' END, CASE WHEN s2 AND k % 5 <> 0 THEN 's' END) AS seller,
 CASE WHEN NOT (s1 OR s2) THEN NULL WHEN s1 AND k % 4 <> 0 THEN 'I1' WHEN s2 AND k % 5 <> 0 THEN 'I2' ELSE '' END AS ibans,
 CAST(CASE WHEN k % 7 <> 0 THEN 1 WHEN k % 8 <> 0 THEN 2 END AS DOUBLE) AS rate FROM c""")
def envelope_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    o = o.select("k", _candidate(k, "p", 1).alias("p"), _candidate(k, "s", 2).alias("s"))
    m = o.select("k", M.merge_invoices(F.col("p"), F.col("s")).alias("m"))
    return m.select("k", "m.invoice_number", "m.issue_date", "m.totals.net", "m.totals.tax", F.col("m.seller.name").alias("seller"), F.array_join("m.seller.ibans", ",").alias("ibans"), F.get("m.vat_breakdown", F.lit(0))["rate"].alias("rate"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k, CAST(CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n, CASE WHEN k % 2 = 0 THEN 'template' ELSE 'rules' END AS number_source, CASE WHEN k % 2 = 0 THEN 0.6 ELSE 0.65 END AS least FROM o""")
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary knows the number and the net of even orders; the secondary the number and the tax of all."""
    def meta(source: str, confidence: float) -> Column:
        return F.struct(F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))

    none = F.create_map().cast("map<string,struct<source:string,confidence:double>>")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    p = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("invoiceNumber"), meta("template", 0.95), F.lit("totals.net"), meta("template", 0.6))).otherwise(none)
    s = F.create_map(F.lit("invoiceNumber"), meta("rules", 0.65), F.lit("totals.tax"), meta("rules", 0.65))
    m = o.select("k", M.merge_meta(p, s).alias("m"))
    return m.select("k", F.size("m").alias("n"), F.element_at("m", F.lit("invoiceNumber"))["source"].alias("number_source"), M.least_confidence(F.col("m")).alias("least"))


@query(PAGE_SQL + """SELECT k, array_to_string(lines, chr(10)) || CASE WHEN style < 3 THEN chr(10) || chr(10) || '| Pos | Bezeichnung | Betrag |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 1 | Ware | ' || de || ' |' || chr(10) || '| 2 | Fracht | ' || en || ' |' ELSE '' END AS markdown FROM p""")
def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("k", C.markdown(F.col("lines"), F.col("tables")).alias("markdown"))


@query("""WITH e AS (SELECT user_id AS doc_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
SELECT doc_id, string_agg(event_type, ' > ' ORDER BY event_id) AS path, CAST(count(*) AS INTEGER) AS hops FROM e WHERE last IS NULL OR last <> event_type GROUP BY doc_id""")
def trace_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "event_type")
    return R.path(e, "doc_id", "event_type", "event_id")


@query("""SELECT u.doc_id AS root, e.event_id, e.event_type FROM (SELECT DISTINCT user_id AS doc_id FROM events WHERE user_id % 10 = 0) u JOIN events e ON e.user_id = u.doc_id OR (e.user_id // 10 * 10 = u.doc_id AND e.user_id <> u.doc_id)""")
def trace_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents divisible by 10 are parents of the nine that follow."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "event_type")
    docs = e.select("doc_id").distinct().withColumn("parent_id", F.when(F.col("doc_id") % 10 != 0, F.floor(F.col("doc_id") / 10) * 10))
    return R.trace(e, docs, F.col("doc_id") % 10 == 0).select("root", "event_id", "event_type")


@query("""WITH d AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS before FROM orders), e AS (SELECT user_id AS doc_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT d.doc_id, CAST(d.before + coalesce(e.n, 0) AS INTEGER) AS attempts, CASE WHEN e.n IS NOT NULL AND d.before + e.n >= 3 THEN 'failed' ELSE 'routed' END AS status, CASE WHEN e.n IS NOT NULL THEN 'boom' END AS error FROM d LEFT JOIN e USING (doc_id)""")
def stage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    docs = read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit("routed").alias("status"), (k % 3).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"))
    errors = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"), F.lit("boom").alias("message"))
    return R.after_error(docs, errors, 3).select("doc_id", "attempts", "status", "error")


_STATUS_SQL = """WITH d AS (SELECT o_orderkey AS doc_id, o_orderdate AS created_at, ['received', 'routed', 'extracted', 'pending_review', 'committed', 'failed'][o_orderkey % 6 + 1] AS status,
 ['zugferd', 'text', 'image', NULL][o_orderkey % 4 + 1] AS route, CAST(o_orderkey % 5 AS INTEGER) AS attempts FROM orders)
"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("received", "routed", "extracted", "pending_review", "committed", "failed"))), (k % 6).cast("int"))
    route = F.get(F.array(F.lit("zugferd"), F.lit("text"), F.lit("image"), F.lit(None)), (k % 4).cast("int"))
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), route.alias("route"), (k % 5).cast("int").alias("attempts"))


@query(_STATUS_SQL + "SELECT status, route, count(*) AS n FROM d GROUP BY status, route")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).groupBy("status", "route").agg(F.count("*").alias("n"))


@query(_STATUS_SQL + "SELECT doc_id, status FROM d WHERE (status IN ('received', 'extracted', 'escalated_vlm') OR (status = 'routed' AND route IN ('zugferd', 'text', 'image'))) AND attempts < 3")
def claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).where(R.claimable(3)).select("doc_id", "status")


@query(_STATUS_SQL + "SELECT doc_id, status FROM d WHERE status = 'committed' ORDER BY created_at DESC, doc_id LIMIT 50")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest(stored(spark, sf_dir), 50, "committed").select("doc_id", "status")


@query(_STATUS_SQL + "SELECT doc_id, 'C1_TOTALS,VAT_MISSING' AS failed FROM d WHERE status = 'pending_review' ORDER BY created_at DESC, doc_id LIMIT 100")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    def violation(name: str) -> Column:
        return F.struct(F.lit(name).alias("constraint"), F.array().cast("array<string>").alias("paths"), F.lit("").alias("detail"), none.alias("delta"), none.alias("hint")).cast(VIOLATION)

    d = stored(spark, sf_dir).withColumn("violations", F.array(violation("C1_TOTALS"), violation("VAT_MISSING")))
    return R.review_queue(d).select("doc_id", F.array_join("failed", ",").alias("failed"))


@query("""SELECT event_id, user_id AS doc_id, CASE WHEN user_id % 3 = 0 THEN 'reviewed' ELSE 'open' END AS resolution FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100""")
def escalation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as escalations; every third document's are resolved, all at once."""
    e = read(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "ts", F.col("user_id").alias("doc_id"), F.lit("open").alias("resolution"))
    done = e.where("doc_id % 3 = 0").select("doc_id", F.lit("reviewed").alias("resolution")).distinct()
    return R.newest(R.resolved(e, done), 100, order="ts", tie="event_id").select("event_id", "doc_id", "resolution")


@query(_STATUS_SQL + """SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 404 WHEN status <> 'pending_review' THEN 409 WHEN doc_id % 2 = 0 THEN 422 ELSE 200 END AS INTEGER) AS code FROM d""")
def review_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections for all documents, of which those divisible by 7 are not stored; even bodies do not add up, and those
    divisible by 5 only lack a VAT row, which does not block."""
    d = stored(spark, sf_dir)
    none = F.lit(None).cast("string")
    def violation(name: str) -> Column:
        return F.struct(F.lit(name).alias("constraint"), F.array().cast("array<string>").alias("paths"), F.lit("").alias("detail"), none.alias("delta"), none.alias("hint")).cast(VIOLATION)

    found = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, violation("C2_LINE_SUM")), F.when(F.col("doc_id") % 5 == 0, violation("VAT_MISSING"))), lambda v: v.isNotNull())
    return R.commit_review(d.where("doc_id % 7 <> 0"), d.select("doc_id"), found).select("doc_id", "code")


@query(AMOUNT_SQL + """, v AS (SELECT k, dot FROM x)
SELECT k AS doc_id, 'gross' AS path, dot AS expected, CASE WHEN k % 4 = 0 THEN dot || '1' END AS actual FROM v WHERE k % 4 IN (0, 1)""")
def canonical_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross amounts against others that differ, are missing, carry more zeros or are equal."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"))
    k = F.col("doc_id") % 4
    e = o.withColumn("path", F.lit("gross"))
    a = e.where(k != 1).withColumn("value", F.when(k == 0, F.concat("value", F.lit("1"))).when(k == 2, F.concat("value", F.lit("00"))).otherwise(F.col("value")))
    return R.diff(e, a)


CII = """<rsm:CrossIndustryInvoice xmlns:rsm="urn:a" xmlns:ram="urn:b" xmlns:udt="urn:c"><rsm:ExchangedDocument><ram:ID>%s</ram:ID><ram:IssueDateTime><udt:DateTimeString format="102">%s</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument><rsm:SupplyChainTradeTransaction>%s<ram:ApplicableHeaderTradeAgreement><ram:SellerTradeParty><ram:Name>S %s</ram:Name><ram:SpecifiedTaxRegistration><ram:ID schemeID="VA">DE %s</ram:ID></ram:SpecifiedTaxRegistration></ram:SellerTradeParty></ram:ApplicableHeaderTradeAgreement><ram:ApplicableHeaderTradeSettlement><ram:InvoiceCurrencyCode>EUR</ram:InvoiceCurrencyCode><ram:ApplicableTradeTax><ram:CalculatedAmount>0.00</ram:CalculatedAmount><ram:BasisAmount>%s</ram:BasisAmount><ram:RateApplicablePercent>0</ram:RateApplicablePercent></ram:ApplicableTradeTax><ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:LineTotalAmount>%s</ram:LineTotalAmount>%s<ram:GrandTotalAmount>%s</ram:GrandTotalAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement></rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>"""


@query(AMOUNT_SQL + """, y AS (SELECT x.k, x.dot, CAST(o_orderdate AS DATE) AS d, k % 5 = 4 AS broken FROM x JOIN orders ON o_orderkey = x.k)
SELECT k, CASE WHEN NOT broken THEN 'R-' || k END AS invoice_number, CASE WHEN NOT broken THEN strftime(d, '%Y-%m-%d') END AS issue_date, CASE WHEN NOT broken THEN 'DE' || k END AS vat_id,
 CASE WHEN NOT broken THEN dot END AS net, CASE WHEN NOT broken AND k % 3 <> 0 THEN '0.00' END AS tax, CASE WHEN NOT broken AND k % 7 <> 0 THEN dot END AS gross,
 CAST(CASE WHEN broken THEN 0 WHEN k % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS items, broken AS failed FROM y""")
def cii_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-invoices rendered from orders. Every third has its tax total twice, every seventh a gross with a plus sign, and
    every fifth is cut short; even ones have two items with a name and all have one without."""
    k = F.col("o_orderkey")
    o = spread(read(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("dot"), F.date_format("o_orderdate", "yyyyMMdd").alias("d")))

    def item(name: str) -> str:
        return f"<ram:IncludedSupplyChainTradeLineItem><ram:AssociatedDocumentLineDocument><ram:LineID>1</ram:LineID></ram:AssociatedDocumentLineDocument>{name}</ram:IncludedSupplyChainTradeLineItem>"

    named = item("<ram:SpecifiedTradeProduct><ram:Name>Ware</ram:Name></ram:SpecifiedTradeProduct>")
    items = F.when(F.col("k") % 2 == 0, F.lit(named + item("") + named)).otherwise(F.lit(item("") + named))
    total = '<ram:TaxTotalAmount currencyID="EUR">0.00</ram:TaxTotalAmount>'
    taxes = F.when(F.col("k") % 3 == 0, F.lit(total * 2)).otherwise(F.lit(total))
    gross = F.when(F.col("k") % 7 == 0, F.concat(F.lit("+"), F.col("dot"))).otherwise(F.col("dot"))
    xml = F.format_string(CII, F.concat(F.lit("R-"), F.col("k")), "d", items, F.col("k"), F.col("k"), "dot", "dot", taxes, gross)
    o = o.select("k", F.when(F.col("k") % 5 == 4, F.substring(xml, 1, 400)).otherwise(xml).alias("xml"))
    read_ = X.read_xml(o)
    i = F.col("invoice")
    return read_.select("k", i["invoice_number"].alias("invoice_number"), i["issue_date"].alias("issue_date"), i["seller"]["vat_id"].alias("vat_id"), i["totals"]["net"].alias("net"), i["totals"]["tax"].alias("tax"), i["totals"]["gross"].alias("gross"), F.coalesce(F.size(i["line_items"]), F.lit(0)).alias("items"), F.col("error").isNotNull().alias("failed"))
