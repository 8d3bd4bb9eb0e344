"""Stages of the batch plan and stored rows, over orders, events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile as S
from ..operators import records as R
from ..operators import segment as G
from ..operators import vendors as V
from ..plans import pipeline as P
from ..plans.options import Options
from ..plans.schemas import CANONICAL, INVOICE, LINE, META, TABLE, struct_type
from ..sources import ports
from . import query, read, spread
from .layouts import PAGES_SQL, paged
from .records import CII, IDS, _said, stored
from .templates import _line, induced
from .texts import AMOUNT_SQL

O_SQL = "WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)\n"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))


def _pick(at: Column, *values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


NAMES = ("factur-x.xml", "ZUGFeRD-invoice.xml", "XRECHNUNG.XML", "my-zugferd-2.xml", "FacturX_1.xml.bak", "notes.xml", "xrechnung.xml.txt")


@query(O_SQL + """SELECT k, CASE WHEN k % 7 < 5 THEN 'zugferd' WHEN k % 60 > 50 THEN 'text' ELSE 'image' END AS route FROM o""")
def route_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attachment's name wins, then the number of characters; the last two patterns fit anywhere in a name."""
    names = F.array(F.lit("readme.txt"), _pick(F.col("k") % 7, *NAMES))
    return keys(spark, sf_dir).select("k", P.route(names, F.col("k") % 60, Options()).alias("route"))


@query(AMOUNT_SQL + """SELECT x.k AS doc_id, CASE WHEN x.k % 5 = 4 THEN 'text' ELSE 'extracted' END AS next, CASE WHEN x.k % 5 = 4 THEN 'xml_fallthrough' END AS reason, CASE WHEN x.k % 5 <> 4 THEN 'R-' || x.k END AS invoice_number,
 CASE WHEN x.k % 5 <> 4 THEN 'zugferd' END AS source, CASE WHEN x.k % 5 <> 4 THEN CAST(1 AS DOUBLE) END AS confidence FROM x""")
def xml_fallthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fitting attachment, without its byte order mark, through the reader; every fifth is cut short."""
    o = spread(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("dot"), F.date_format("o_orderdate", "yyyyMMdd").alias("d")))
    xml = F.format_string(CII, _said("R-", F.col("k")), "d", F.lit(""), F.col("k"), F.col("k"), "dot", "dot", F.lit(""), "dot")
    xml = F.concat(F.lit("﻿"), F.when(F.col("k") % 5 == 4, F.substring(xml, 1, 300)).otherwise(xml))

    def attached(name: str, content: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), content.cast("binary").alias("content"))

    d = o.select(F.col("k").alias("doc_id"), F.array(attached("a.txt", F.lit("x")), attached("factur-x.xml", xml), attached("xrechnung.xml", F.lit("<y/>"))).alias("attachments"))
    done = P.xml_lane(d)
    meta = F.try_element_at("field_meta", F.lit("*"))
    return done.select("doc_id", "next", "reason", F.col("invoice.invoice_number").alias("invoice_number"), meta["source"].alias("source"), meta["confidence"].alias("confidence"))


@query(PAGES_SQL + """, c AS (SELECT conv_id, segment, bool_or(attachment) AS attachment, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, count(*) AS n FROM s GROUP BY conv_id, segment),
m AS (SELECT conv_id FROM c WHERE NOT attachment GROUP BY conv_id HAVING count(*) > 1)
SELECT sha256(conv_id || ':' || pages) AS doc_id, CAST(conv_id AS VARCHAR) AS parent_id, CAST(n AS INTEGER) AS page_count, CAST(3 * n AS INTEGER) AS n_lines, CAST(n AS INTEGER) AS last_page FROM c JOIN m USING (conv_id) WHERE NOT attachment""")
def segment_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child for each invoice of a document of several, named by a hash of parent and pages, with its pages alone."""
    d = paged(spark, sf_dir).select(F.col("conv_id").cast("string").alias("doc_id"), "lines", "page_count")
    d = d.withColumn("segments", G.segments(G.page_features(F.col("lines"), F.col("page_count"))))
    many = F.size(F.filter("segments", lambda s: s["kind"] == "invoice-candidate")) > 1
    laned = d.withColumns({"next": F.when(many, "segmented").otherwise("extract"), "tables": F.array().cast(f"array<{TABLE}>")})
    c = P.segment_children(laned)
    return c.select("doc_id", "parent_id", "page_count", F.size("lines").alias("n_lines"), F.array_max(F.transform("lines", lambda x: x["page"])).alias("last_page"))


@query(O_SQL + """, f AS (SELECT k, k % 2 = 0 AS solved, k % 3 = 0 AS total, k % 5 < 3 AS invoice, k % 7 < 4 AS shown, k % 11 < 4 AS asked FROM o)
SELECT k, CASE WHEN solved THEN 'committed' WHEN total AND invoice AND shown THEN 'exported_markdown' ELSE 'pending_review' END AS without_model,
 CASE WHEN solved THEN 'committed' WHEN total AND invoice AND shown THEN 'exported_markdown' WHEN NOT asked THEN 'escalated_vlm' ELSE 'pending_review' END AS with_model FROM f""")
def stage_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    d = keys(spark, sf_dir).select("k", F.when(k % 2 == 0, "reconciled").otherwise("failed").alias("status"), (k % 3 == 0).alias("total_failure"), F.when(k % 5 < 3, "invoice").otherwise("uncertain").alias("band"), F.when(k % 7 < 4, "# x").alias("markdown"), (k % 11 < 4).alias("vlm_attempted"))
    d = P.decide(d, Options()).withColumnRenamed("next", "without_model")
    return P.decide(d, Options(model_enabled=True)).select("k", "without_model", F.col("next").alias("with_model"))


@query(O_SQL + """SELECT k AS doc_id, CASE WHEN k % 4 IN (0, 2) THEN 'extracted' ELSE 'exported_markdown' END AS next, CASE WHEN k % 4 IN (0, 2) THEN 'R-' || k END AS invoice_number, CASE WHEN k % 4 = 1 THEN 'letter ' || k WHEN k % 4 = 3 THEN 'again' END AS markdown, 'vlm' AS source, CAST(0.75 AS DOUBLE) AS confidence FROM o""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in fences, plain, and no JSON at all, which is asked for once more."""
    k = F.col("k")
    d = keys(spark, sf_dir).select(k.alias("doc_id"), F.lit("old").alias("markdown"), F.lit(None).alias("invoice"), F.lit(None).alias("field_meta"))
    body = F.concat(F.lit('{"is_invoice":true,"invoice":{"schema_version":1,"invoice_number":"R-'), F.col("doc_id").cast("string"), F.lit('"},"markdown":null}'))
    letter = F.concat(F.lit('{"is_invoice":false,"invoice":null,"markdown":"'), F.when(F.col("doc_id") % 4 == 1, _said("letter ", F.col("doc_id"))).otherwise("again"), F.lit('"}'))
    good = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\n```json\n"), body, F.lit("\n```\n"))).when(F.col("doc_id") % 4 == 2, body).otherwise(letter)
    calls = []

    def ask(asked: DataFrame) -> DataFrame:
        calls.append(1)
        reply = F.when(F.col("doc_id") % 4 == 3, F.lit("Sorry, no.")).otherwise(good) if len(calls) == 1 else good
        return asked.select("doc_id", reply.alias("reply"))

    done = P.ask_model(d, ports.retried(ask))
    meta = F.element_at("field_meta", F.lit("*"))
    return done.select("doc_id", "next", F.col("invoice.invoice_number").alias("invoice_number"), "markdown", meta["source"].alias("source"), meta["confidence"].alias("confidence"))


@query(O_SQL + """SELECT k AS doc_id, CASE WHEN k % 10 IN (3, 9) THEN 'human_review' WHEN k % 10 IN (1, 7) THEN 'vlm' ELSE 'rule_engine' END AS source, 'DE811907980' AS vat_id FROM o WHERE k % 10 IN (1, 3, 5, 7, 9)""")
def template_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What committed documents teach: a template's own values teach nothing, nor do documents without lines."""
    k = F.col("k")
    by = F.when(k % 10 == 0, "template").when(k % 10 < 3, "vlm").when(k % 10 == 3, "human").when(k % 10 == 7, "vlm").when(k % 10 == 9, "human").otherwise("rules")
    d = induced(spark, sf_dir).where("k % 4 <> 0 OR k % 2 = 0").withColumns({"doc_id": k, "by": by})
    d = d.withColumn("lines", F.when(k % 2 == 1, F.col("lines")).otherwise(F.array().cast(f"array<{LINE}>")))
    return P.induce(d, Options()).select("doc_id", "source", F.col("ids.vat_id").alias("vat_id"))


@query(O_SQL + """, c AS (SELECT k, k % 6 AS c FROM o)
SELECT k AS doc_id, CASE WHEN c IN (0, 1, 5) THEN 'reconciled' ELSE 'failed' END AS status, CASE c WHEN 2 THEN 'LINE_TOTAL_UNRESOLVED' WHEN 3 THEN 'REQUIRED_MISSING' WHEN 4 THEN 'SCHEMA_INVALID' ELSE '' END AS violations,
 CASE WHEN c IN (0, 1, 5) THEN 'R-' || k || ' EUR 100.00 19.00 119.00 2 50' END AS canonical, CASE c WHEN 1 THEN 'totals.gross:derived:0.45' WHEN 5 THEN 'totals.tax:derived:0.45' ELSE '' END AS derived FROM c""")
def reconcile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes to canonical invoices: whole ones, a gross that is missing, a line without total and price, no number, a
    date in the wrong shape, and a tax that is no number. Every repaired path gets 0.9 times the least confidence."""
    c = F.col("k") % 6
    none = F.lit(None)
    item = F.struct(F.lit(1).alias("position"), F.lit(" Ware ").alias("description"), F.when(c != 2, "2.0000").alias("quantity"), none.alias("unit"), F.when(c != 2, "50.00").alias("unit_price"), F.lit(19.0).alias("tax_rate"), F.when(c != 2, "100").alias("line_total"))
    kinds = {f.name: f.dataType for f in struct_type(INVOICE).fields}
    seller = F.struct(F.lit("ACME").alias("name"), none.alias("vat_id"), none.alias("tax_number"), none.alias("ibans"), none.alias("address"))
    values = {
        "invoice_number": F.when(c != 3, F.concat(F.lit(" R-"), F.col("k").cast("string"), F.lit(" "))),
        "issue_date": F.when(c == 4, "15.06.2026").otherwise("2026-06-15"),
        "seller": seller,
        "totals": F.struct(F.lit("100.00").alias("net"), F.when(c == 5, "poison").otherwise("19.00").alias("tax"), F.when(c != 1, " 119.00 ").alias("gross")),
        "vat_breakdown": F.array(F.struct(F.lit(19.0).alias("rate"), F.lit("100.00").alias("net"), F.lit("19.00").alias("tax"))),
        "line_items": F.array(item),
    }
    invoice = F.struct(*[values.get(n, none).cast(t).alias(n) for n, t in kinds.items()])

    def meta(confidence: float) -> Column:
        return F.struct(F.lit("rules").alias("source"), F.lit(confidence).alias("confidence"), none.cast("string").alias("raw_text"), none.cast("int").alias("page"), none.alias("box")).cast(META)

    d = keys(spark, sf_dir).select(F.col("k").alias("doc_id"), "k").select("doc_id", invoice.alias("invoice"), F.create_map(F.lit("totals.net"), meta(0.5), F.lit("invoiceNumber"), meta(0.65)).alias("field_meta"))
    r = S.reconcile(d)
    i, x = F.col("invoice"), F.get("invoice.line_items", F.lit(0))
    shown = F.when(i.isNotNull(), F.concat_ws(" ", i["invoice_number"], i["currency"], i["totals"]["net"], i["totals"]["tax"], i["totals"]["gross"], x["quantity"], x["unit_price"]))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("derived"), lambda e: F.concat_ws(":", e["key"], e["value"]["source"], F.round(e["value"]["confidence"], 4).cast("string")))), ",")
    return r.select("doc_id", "status", F.array_join(F.array_distinct(F.transform("violations", lambda v: v["constraint"])), ",").alias("violations"), shown.alias("canonical"), F.when(F.col("status") == "reconciled", told).otherwise("").alias("derived"))


@query(O_SQL + """SELECT k, 'invoice_number=R-' || k || ';line_items.0.description=Ware;line_items.1.line_total=2.00;seller.ibans.0=DE1;totals.gross=' || CASE WHEN k % 3 = 0 THEN 'new' ELSE '1.00' END || CASE WHEN k % 3 = 0 THEN ';vat_breakdown.1.net=9.00' ELSE '' END AS leaves FROM o""")
def dotted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read and written by dotted path; writing makes the containers that are missing."""
    k, none = F.col("k"), F.lit(None)
    kind = struct_type(INVOICE)
    kinds = {f.name: f.dataType for f in kind.fields}

    def item(**v: str) -> Column:
        return F.struct(*[F.lit(v.get(n)).alias(n) for n in ("position", "description", "quantity", "unit", "unit_price", "tax_rate", "line_total")])

    values = {"invoice_number": _said("R-", k), "seller": F.struct(none.alias("name"), none.alias("vat_id"), none.alias("tax_number"), F.array(F.lit("DE1")).alias("ibans"), none.alias("address")), "totals": F.struct(none.alias("net"), none.alias("tax"), F.lit("1.00").alias("gross")), "line_items": F.array(item(description="Ware"), item(line_total="2.00"))}
    d = keys(spark, sf_dir).select("k", F.struct(*[values.get(n, none).cast(t).alias(n) for n, t in kinds.items()]).alias("x"))
    written = R.set_path(R.set_path(F.col("x"), kind, "totals.gross", F.lit("new")), kind, "vat_breakdown.1.net", F.lit("9.00"))
    d = d.select("k", F.when(k % 3 == 0, written).otherwise(F.col("x")).alias("x"))
    return d.select("k", F.array_join(F.array_sort(F.transform(R.leaves(F.col("x"), kind), lambda e: F.concat_ws("=", e["path"], e["value"]))), ";").alias("leaves"))


@query(O_SQL + """SELECT k AS doc_id, 'items.0.total' AS path, '1.00' AS expected, '2.00' AS actual FROM o WHERE k % 4 = 1 UNION ALL SELECT k, 'items.1.total', NULL, '5' FROM o WHERE k % 4 = 2 UNION ALL SELECT k, 'name', 'x', 'y' FROM o WHERE k % 4 = 3""")
def nested_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values against others: a number of other digits but one value, another value, one more element, another
    word."""
    k = F.col("doc_id") % 4
    kind = "struct<name:string,items:array<struct<total:string>>>"

    def made(name: Column, *totals: Column) -> Column:
        return F.struct(name.alias("name"), F.array(*[F.struct(t.alias("total")) for t in totals]).alias("items")).cast(kind)

    d = keys(spark, sf_dir).select(F.col("k").alias("doc_id"))
    e = d.withColumn("x", made(F.lit("x"), F.lit("1.00")))
    one = F.when(k == 0, "1.000").when(k == 1, "2.00").otherwise("1.00")
    a = d.withColumn("x", F.when(k == 2, made(F.lit("x"), F.lit("1.00"), F.lit("5"))).otherwise(made(F.when(k == 3, "y").otherwise("x"), one)))
    return R.nested_diff(e, a, "x")


@query(O_SQL + """, d AS (SELECT k % 100 AS request, k // 100 AS n, CASE WHEN k % 13 = 0 THEN '' ELSE 'body ' || (k % 997) END AS body FROM o),
p AS (SELECT *, sha256(body) AS content_hash, row_number() OVER (PARTITION BY request ORDER BY body = '', n) AS place FROM d),
f AS (SELECT content_hash, min((request, n)) AS first FROM p WHERE body <> '' AND place <= 50 GROUP BY content_hash),
r AS (SELECT p.*, f.first, CASE WHEN body = '' THEN 'empty' WHEN place > 50 THEN 'too_many' WHEN body = 'body 7' THEN 'duplicate' WHEN f.first = (request, n) THEN 'stored' ELSE 'duplicate' END AS outcome FROM p LEFT JOIN f USING (content_hash))
SELECT request, n, 'f' || n AS filename, content_hash, outcome, CASE WHEN outcome IN ('stored', 'duplicate') THEN CASE WHEN body = 'body 7' THEN 'held' ELSE first[1] || '/' || first[2] END END AS doc_id FROM r""")
def intake_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each file of many requests: limits, known content and content that comes twice."""
    k = F.col("k")
    content = F.when(k % 13 == 0, "").otherwise(_said("body ", k % 997)).cast("binary")
    files = keys(spark, sf_dir).select((k % 100).alias("request"), F.floor(k / 100).alias("n"), _said("f", F.floor(k / 100)).alias("filename"), content.alias("content"))
    held = spark.range(1).select(F.lit("held").alias("doc_id"), F.lit("committed").alias("status"), F.sha2(F.lit("body 7").cast("binary"), 256).alias("content_hash"))
    failed = spark.range(1).select(F.lit("lost").alias("doc_id"), F.lit("failed").alias("status"), F.sha2(F.lit("body 8").cast("binary"), 256).alias("content_hash"))
    return R.intake(files, held.unionAll(failed))


STATUS_SQL = """WITH d AS (SELECT o_orderkey AS doc_id, o_orderdate AS created_at, ['received', 'routed', 'extracted', 'pending_review', 'committed', 'failed'][o_orderkey % 6 + 1] AS status,
 ['zugferd', 'text', 'image', NULL][o_orderkey % 4 + 1] AS route, CAST(o_orderkey % 5 AS INTEGER) AS attempts FROM orders)
"""


@query(STATUS_SQL + "SELECT doc_id, status FROM d WHERE (status IN ('received', 'extracted', 'escalated_vlm') OR (status = 'routed' AND route IN ('zugferd', 'text', 'image'))) AND attempts < 3 ORDER BY created_at, doc_id LIMIT 25")
def claim_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.claim(stored(spark, sf_dir), 3, 25).select("doc_id", "status")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with every column of a document."""
    d = stored(spark, sf_dir)
    made = {"markdown": F.when(F.col("doc_id") % 3 == 0, _said("# ", F.col("doc_id"))), "canonical": _said("c", F.col("doc_id")), "filename": _said("f", F.col("doc_id"))}
    for c in (*R.SUMMARY, *R.DETAIL):
        if c not in d.columns:
            d = d.withColumn(c, made.get(c, F.lit(None).cast("string")))
    return d.withColumn("content", _said("bytes ", F.col("doc_id")).cast("binary"))


@query(STATUS_SQL + "SELECT doc_id, status, route, attempts, 'f' || doc_id AS filename, 'c' || doc_id AS canonical, CASE WHEN doc_id % 3 = 0 THEN '# ' || doc_id END AS markdown, CAST(10 AS INTEGER) AS in_summary, CAST(18 AS INTEGER) AS in_detail FROM d")
def document_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a listing and the detail of one document, without content."""
    d = _whole(spark, sf_dir)
    short, long = R.summary(d), R.detail(d)
    return short.select("doc_id", "status", "route", "attempts", "filename", F.lit(len(short.columns)).alias("in_summary")).join(long.select("doc_id", "canonical", "markdown", F.lit(len(long.columns)).alias("in_detail")), "doc_id")


@query(STATUS_SQL + """, a AS (SELECT o_orderkey + 7 AS doc_id FROM orders), j AS (SELECT a.doc_id, d.doc_id IS NOT NULL AS there, d.status FROM a LEFT JOIN d USING (doc_id))
SELECT doc_id, CAST(CASE WHEN NOT there OR doc_id % 3 <> 0 THEN 404 ELSE 200 END AS INTEGER) AS markdown_code, CASE WHEN there AND doc_id % 3 = 0 THEN '# ' || doc_id END AS markdown,
 CAST(CASE WHEN NOT there THEN 404 WHEN status <> 'pending_review' THEN 409 ELSE 200 END AS INTEGER) AS review_code, CASE WHEN there AND status = 'pending_review' THEN 'c' || doc_id END AS canonical, CAST(CASE WHEN there THEN 200 ELSE 404 END AS INTEGER) AS content_code FROM j""")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown, review detail and content by id: absent rows, absent values and rows that do not wait for review."""
    d = _whole(spark, sf_dir)
    asked = d.select((F.col("doc_id") + 7).alias("doc_id"))
    m = R.looked_up(asked, d, "markdown").withColumnRenamed("code", "markdown_code")
    r = R.looked_up(asked, d, "canonical", wait_for="pending_review").withColumnRenamed("code", "review_code")
    c = R.looked_up(asked, d, "content").select("doc_id", F.col("code").alias("content_code"))
    return m.join(r, "doc_id").join(c, "doc_id")


@query(O_SQL + "SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'own ' || k WHEN k % 10 IN (1, 3) THEN 'own ' || (k // 10 * 10) END AS content FROM o")
def parent_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents have no file; some of them are children of the document at the start of their ten."""
    k = F.col("k")
    docs = keys(spark, sf_dir).select(k.alias("doc_id"), F.when((k % 10).isin(1, 3), F.floor(k / 10) * 10).alias("parent_id"))
    files = keys(spark, sf_dir).where("k % 2 = 0").select(k.alias("doc_id"), _said("own ", k).alias("content"))
    return R.with_parent_content(docs, files).select("doc_id", "content")


@query("""WITH e AS (SELECT user_id AS doc_id, event_id, CASE event_type WHEN 'view' THEN 'route:' || CASE WHEN event_id % 2 = 0 THEN 'text' ELSE '?' END WHEN 'click' THEN 'gate:ok' WHEN 'signup' THEN 'class:' || 'invoice' WHEN 'purchase' THEN 'solver:failed' ELSE 'error' END AS label FROM events),
l AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY event_id) AS last FROM e)
SELECT doc_id, string_agg(label, ' > ' ORDER BY event_id) AS path, CAST(count(*) AS INTEGER) AS hops FROM l WHERE last IS NULL OR last <> label GROUP BY doc_id""")
def hop_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages: the short label of each, and a document's path."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "event_type")
    names = F.create_map(*[F.lit(x) for kv in (("view", "routed"), ("click", "text_gate"), ("signup", "classified"), ("purchase", "reconciled"), ("error", "stage_error")) for x in kv])
    detail = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), '{"route":"text"}').when(F.col("event_type") == "click", '{"verdict":"ok"}').when(F.col("event_type") == "signup", '{"band":"invoice"}').when(F.col("event_type") == "purchase", '{"status":"failed"}').otherwise("{}")
    labelled = e.withColumn("label", R.hop_label(F.element_at(names, F.col("event_type")), detail))
    return R.path(labelled, "doc_id", "label", "event_id")


@query("SELECT s_suppkey AS template_id, 'V' || s_suppkey AS vat_id, 'vendor ' || s_suppkey AS display_name, 's' || (s_suppkey % 7) AS updated_at FROM supplier ORDER BY updated_at DESC, s_suppkey LIMIT 100")
def template_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("s_suppkey"), F.lit(None)
    ids = F.struct(_said("V", k).alias("vat_id"), none.alias("tax_number"), none.alias("ibans"), none.alias("name_hash")).cast(IDS)
    t = read(spark, sf_dir, "supplier").select(k.alias("template_id"), ids.alias("ids"), F.struct(F.struct(_said("vendor ", k).alias("display_name")).alias("vendor_ids")).alias("body"), _said("s", k % 7).alias("updated_at"))
    return V.latest(t).select("template_id", "ids.vat_id", "display_name", "updated_at")


@query(O_SQL + """SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN k % 3 = 0 THEN 'C1_TOTALS' ELSE 'low_confidence' END AS reason, 'open' AS resolution FROM o WHERE k % 2 = 0""")
def escalation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    reason = F.when(k % 2 == 0, F.when(k % 3 == 0, "C1_TOTALS").otherwise("low_confidence"))
    return R.escalations(keys(spark, sf_dir).withColumn("doc_id", k), reason).drop("at")


@query(O_SQL + """SELECT CAST(k AS VARCHAR) AS doc_id, 'classified' AS event, '{"band":"' || CASE WHEN k % 2 = 0 THEN 'invoice' ELSE 'uncertain' END || '","score":' || (k % 10) || '}' AS detail FROM o""")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    d = keys(spark, sf_dir).withColumn("doc_id", k)
    return ports.events(d, "classified", band=F.when(k % 2 == 0, "invoice").otherwise("uncertain"), score=k % 10).drop("at")


@query(STATUS_SQL + """, c AS (SELECT doc_id, doc_id % 7 = 0 AS absent, status <> 'pending_review' AS late, doc_id % 5 = 0 AS shapeless, doc_id % 2 = 0 AS wrong, status FROM d),
r AS (SELECT *, CAST(CASE WHEN absent THEN 404 WHEN late THEN 409 WHEN shapeless THEN 400 WHEN wrong THEN 422 ELSE 200 END AS INTEGER) AS code FROM c)
SELECT doc_id, code, CASE WHEN wrong THEN 'C1_TOTALS' ELSE '' END AS blocking, CASE WHEN code = 200 THEN 'R-' || doc_id END AS number, CASE WHEN code = 200 THEN 'committed' WHEN code <> 404 THEN status END AS status, CASE WHEN code = 200 THEN 'human_review' END AS taught FROM r""")
def review_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole corrections of all documents: what each is answered, what is stored and what it teaches. Even gross amounts
    are wrong, and those divisible by 5 have no number."""
    k, none = F.col("doc_id"), F.lit(None)
    kinds = {f.name: f.dataType for f in struct_type(CANONICAL).fields}
    item = F.struct(F.lit(1).alias("position"), F.lit("Ware").alias("description"), none.alias("quantity"), none.alias("unit"), none.alias("unit_price"), F.lit(19.0).alias("tax_rate"), F.lit("100.00").alias("line_total"))
    values = {
        "schema_version": F.lit(1), "invoice_number": F.when(k % 5 != 0, _said("R-", k)), "issue_date": F.lit("2026-06-15"), "currency": F.lit("EUR"),
        "seller": F.struct(F.lit("ACME").alias("name"), F.lit("DE811907980").alias("vat_id"), none.alias("tax_number"), F.array().alias("ibans"), none.alias("address")),
        "totals": F.struct(F.lit("100.00").alias("net"), F.lit("19.00").alias("tax"), F.when(k % 2 == 0, "120.00").otherwise("119.00").alias("gross")),
        "vat_breakdown": F.array(F.struct(F.lit(19.0).alias("rate"), F.lit("100.00").alias("net"), F.lit("19.00").alias("tax"))), "line_items": F.array(item),
    }
    body = F.struct(*[values.get(n, none).cast(t).alias(n) for n, t in kinds.items()])
    d = spread(stored(spark, sf_dir), "doc_id")
    page = {"lines": F.array(_line(_said("Nr: R-", k), 0.1), _line("Datum 15.06.2026", 0.2)), "tables": F.array().cast(f"array<{TABLE}>"), "page_count": F.lit(1)}
    answers, taught = P.review(d.where("doc_id % 7 <> 0").withColumns(page), d.select("doc_id", body.alias("body")), Options())
    told = answers.select("doc_id", "code", F.array_join(F.transform("blocking", lambda v: v["constraint"]), ",").alias("blocking"), F.col("canonical.invoice_number").alias("number"), "status")
    return told.join(taught.select("doc_id", F.col("source").alias("taught")), "doc_id", "left")
