"""The batch plan: route, gate, segment, classify, resolve, extract, merge, reconcile, decide, learn.

Every step is a projection of a document's row but the vendor lookup (an equi-join over identifiers) and the model
port's join. Between the large steps rows are written to the shared working folder, which keeps plans small. Documents
resolve against the templates as they are at the start of a batch; what a batch induces is folded into the template
table at its end, in the order of documents. A batch of one document is the sequential case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import extract_vendor_ids
from ..operators import classify as C
from ..operators import gate as G
from ..operators import merge as M
from ..operators import reconcile as R
from ..operators import records as D
from ..operators import rules as L
from ..operators import segment as S
from ..operators import template as T
from ..operators import vendors as V
from ..operators.layout import merged_lines
from ..operators.cii import read_xml
from ..sources.ports import Port, embedded_xml, is_invoice_attachment
from ..sources.tables import materialised
from .options import Options
from .schemas import INVOICE, LINE, META, TABLE, TEMPLATE, canonical_issues, struct_type


def route(attachments: Column, characters: Column, options: Options) -> Column:
    """zugferd, text or image. ``attachments``: names; ``characters``: those found on the first pages."""
    return F.when(F.exists(attachments, is_invoice_attachment), "zugferd").when(characters > options.triage.least_characters, "text").otherwise("image")


def xml_lane(df: DataFrame) -> DataFrame:
    """Documents with ``attachments`` through the e-invoice reader: ``invoice``, ``field_meta`` and ``next``, which is
    extracted, or text where the XML does not tell; then ``reason`` is that of an escalation."""
    read = read_xml(embedded_xml(df)).drop("xml")
    bad = F.col("error").isNotNull() | F.col("invoice").isNull()
    meta = F.create_map(F.lit("*"), _source("zugferd", 1.0))
    return read.withColumns({"field_meta": F.when(~bad, meta), "next": F.when(bad, "text").otherwise("extracted"), "reason": F.when(bad, "xml_fallthrough")}).drop("error")


def _source(name: str, confidence: float) -> Column:
    """Provenance of values that no single place shows."""
    return F.struct(F.lit(name).alias("source"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("raw_text"), F.lit(None).cast("int").alias("page"), F.lit(None).alias("box")).cast(META)


def text_lane(df: DataFrame, options: Options, words=G.WORDS) -> DataFrame:
    """Rows with lines, tables and page_count: gate, segments, features and ``next``: image (garbage), segmented (more
    than one invoice), exported_markdown (no invoice), escalated_vlm (uncertain, with a model) or extract. A document
    whose one invoice is among other segments goes on with that segment's pages; without any invoice segment it goes on
    whole."""
    df = df.withColumn("gate", G.text_gate(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), options.gate, words))
    df = df.withColumn("segments", S.segments(S.page_features(F.col("lines"), F.col("page_count"))))
    wanted = F.filter("segments", lambda s: s["kind"] == "invoice-candidate")
    one = (F.size(wanted) == 1) & (F.size("segments") > 1)
    pages = F.get(wanted, F.lit(0))["pages"]
    sliced = {"lines": S.slice_lines(F.col("lines"), pages), "tables": S.slice_tables(F.col("tables"), pages), "page_count": F.size(pages)}
    df = df.withColumn("_one", one).withColumns({k: F.when(F.col("_one"), v).otherwise(F.col(k)) for k, v in sliced.items()}).drop("_one")
    df = df.withColumn("class", C.classify(F.col("lines"), F.col("tables"), options.classify))
    many = F.size(F.filter("segments", lambda s: s["kind"] == "invoice-candidate")) > 1
    unsure = (F.col("class.band") == "uncertain") & F.lit(options.model_enabled)
    step = F.when(F.col("gate.verdict") == "garbage", "image").when(many, "segmented").when(F.col("class.band") == "non_invoice", "exported_markdown").when(unsure, "escalated_vlm").otherwise("extract")
    return df.withColumns({"next": step, "markdown": F.coalesce("markdown", C.markdown(F.col("lines"), F.col("tables")))})


def segment_children(laned: DataFrame) -> DataFrame:
    """Documents for the text lane from those of several invoice segments: one for each, of its pages alone. Its id is
    the hash of parent and pages."""
    many = laned.where("next = 'segmented'")
    rows = D.children(many).join(many.select(F.col("doc_id").alias("parent_id"), "lines", "tables"), "parent_id")
    pages = F.col("pages")
    sliced = S.slice_lines(F.col("lines"), pages).alias("lines"), S.slice_tables(F.col("tables"), pages).alias("tables")
    return rows.select(F.col("content_hash").alias("doc_id"), "parent_id", F.size(pages).alias("page_count"), *sliced, F.lit(None).cast("string").alias("markdown"))


def _candidate(**values: Column) -> Column:
    return F.struct(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct_type(INVOICE).fields]).cast(INVOICE)


def _meta(hits: list[tuple[str, Column, Column, Column]], rows: list[tuple[str, Column, Column, Column]]) -> Column:
    """Provenance from (path, present, source, confidence), and for rows of a list one entry each."""
    def entry(path: Column, source: Column, confidence: Column) -> Column:
        none = F.lit(None)
        meta = F.struct(source.alias("source"), confidence.cast("double").alias("confidence"), none.cast("string").alias("raw_text"), none.cast("int").alias("page"), none.alias("box"))
        return F.struct(path.alias("k"), meta.cast(META).alias("v"))

    single = F.filter(F.array(*[F.when(p, entry(F.lit(n), s, c)) for n, p, s, c in hits]), lambda e: e.isNotNull())
    listed = [F.transform(F.coalesce(items, F.array()), lambda _, i: entry(F.concat(F.lit(f"{n}."), i.cast("string")), s, c)) for n, items, s, c in rows]  # noqa: B023
    return F.map_from_entries(F.concat(single, *listed))


_PATHS = {"invoice_number": "invoiceNumber", "issue_date": "issueDate", "due_date": "dueDate", "net": "totals.net", "tax": "totals.tax", "gross": "totals.gross"}


def rules_envelope(r: Column) -> tuple[Column, Column]:
    totals = F.struct(*[r[n]["value"].alias(n) for n in ("net", "tax", "gross")])
    some = r["net"].isNotNull() | r["tax"].isNotNull() | r["gross"].isNotNull()
    invoice = _candidate(**{n: r[n]["value"] for n in ("invoice_number", "issue_date", "due_date")}, currency=r["currency"], totals=F.when(some, totals), vat_breakdown=F.when(F.size(r["vat"]) > 0, r["vat"]), line_items=r["items"])
    source, certain = F.lit("rules"), F.lit(L.HEADER_CONFIDENCE)
    return invoice, _meta([(p, r[n].isNotNull(), source, certain) for n, p in _PATHS.items()], [("vatBreakdown", r["vat"], source, F.lit(L.ROW_CONFIDENCE)), ("lineItems", r["items"], source, F.lit(L.ROW_CONFIDENCE))])


def template_envelope(a: Column) -> tuple[Column, Column]:
    totals = F.struct(*[a[n]["value"].alias(n) for n in ("net", "tax", "gross")])
    some = a["net"].isNotNull() | a["tax"].isNotNull() | a["gross"].isNotNull()
    s = a["seller"]
    seller = F.struct(s["name"].alias("name"), s["vat_id"].alias("vat_id"), s["tax_number"].alias("tax_number"), s["ibans"].alias("ibans"), F.lit(None).alias("address"))
    invoice = _candidate(**{n: a[n]["value"] for n in ("invoice_number", "issue_date", "due_date")}, totals=F.when(some, totals), line_items=a["items"], seller=seller)
    hits = [(p, a[n].isNotNull(), F.lit("template"), a[n]["confidence"]) for n, p in _PATHS.items()]
    hits.append(("seller.name", s["name"].isNotNull(), F.lit("template"), F.lit(T.NAME_CONFIDENCE)))
    return invoice, _meta(hits, [("lineItems", a["items"], a["row_source"], a["row_confidence"])])


def identity_envelope(ids: Column) -> Column:
    none = F.lit(None)
    seller = F.struct(ids["name_guess"].alias("name"), ids["vat_id"].alias("vat_id"), ids["tax_number"].alias("tax_number"), ids["ibans"].alias("ibans"), none.alias("address"))
    return _candidate(seller=seller)


def extract(df: DataFrame, templates: DataFrame, lexicon: L.Lexicon = L.DEFAULT) -> DataFrame:
    """Rows with lines, tables and page_count to ``invoice`` and ``field_meta``. Rules always run; the template of a
    known vendor is the primary, rules fill its gaps, and identifiers on the page fill the rest. ``templates`` holds
    template_id, ids and template."""
    on_page = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["box"]["y0"].alias("y0")))
    df = df.withColumn("vendor", extract_vendor_ids(on_page))
    df = with_template(df, templates)
    df = df.withColumn("_rules", L.run_rules(F.col("lines"), F.col("tables"), lexicon))
    applied = T.apply_template(F.col("template"), F.col("lines"), F.col("tables"), F.col("page_count"))
    df = df.withColumn("_applied", F.when(F.col("template").isNotNull(), applied))
    (r, r_meta), (a, a_meta) = rules_envelope(F.col("_rules")), template_envelope(F.col("_applied"))
    known = F.col("template").isNotNull()
    none = F.create_map().cast(f"map<string,{META}>")
    df = df.withColumns({"_r": r, "_a": F.when(known, a), "_r_meta": r_meta, "_a_meta": F.when(known, a_meta).otherwise(none), "_i": identity_envelope(F.col("vendor"))})
    df = df.withColumn("_m", F.when(known, M.merge_invoices(F.col("_a"), F.col("_r")).cast(INVOICE)).otherwise(F.col("_r")))
    df = df.withColumns({"invoice": M.merge_invoices(F.col("_m"), F.col("_i")).cast(INVOICE), "field_meta": M.merge_meta(F.col("_a_meta"), F.col("_r_meta")), "fields_missed": F.col("_rules.missed")})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def with_template(df: DataFrame, templates: DataFrame) -> DataFrame:
    """Documents with ``vendor`` and the template of their strongest identifier, matched_by and template_id. Only slim
    rows are resolved; a document and its template meet once, by its id, and rows that repeat one stay as many."""
    ids = F.struct(*[F.col(f"vendor.{n}").alias(n) for n in ("vat_id", "tax_number", "ibans", "name_hash")])
    slim = df.select("doc_id", ids.alias("ids")).dropDuplicates(["doc_id"])
    found = V.resolve(slim, templates).drop("ids").where("template_id IS NOT NULL")
    held = found.join(templates.select("template_id", "template"), "template_id")
    return df.join(held, "doc_id", "left")


def image_lane(df: DataFrame, templates: DataFrame, options: Options) -> DataFrame:
    """Scans: a known vendor's template is applied to the merged words; others go to the model or to review."""
    on_page = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["box"]["y0"].alias("y0")))
    df = df.withColumn("vendor", extract_vendor_ids(on_page))
    df = with_template(df, templates)
    known = F.col("template").isNotNull()
    df = df.withColumn("_merged", merged_lines(F.col("lines")))
    df = df.withColumn("_applied", F.when(known, T.apply_template_ocr(F.col("template"), F.col("_merged"), F.col("page_count")))).drop("_merged")
    a, meta = template_envelope(F.col("_applied"))
    away = F.lit("escalated_vlm" if options.model_enabled else "pending_review")
    return df.withColumns({"invoice": F.when(known, a), "field_meta": F.when(known, meta), "next": F.when(known, "extracted").otherwise(away)}).drop("_applied")


def ask_model(df: DataFrame, port: Port) -> DataFrame:
    """Documents for the model: an invoice becomes an envelope of source vlm, anything else Markdown."""
    said = port(df)
    joined = df.drop("invoice", "field_meta", "markdown").join(said, "doc_id")
    meta = F.create_map(F.lit("*"), _source("vlm", 0.75))
    fields = [f.name for f in struct_type(INVOICE).fields]
    invoice = F.when(F.col("is_invoice"), F.struct(*[F.col(f"reply_invoice.{f}").alias(f) for f in fields]).cast(INVOICE))
    step = F.when(F.col("is_invoice"), "extracted").otherwise("exported_markdown")
    return joined.withColumns({"invoice": invoice, "field_meta": meta, "markdown": F.col("reply_markdown"), "next": step}).drop("is_invoice", "reply_invoice", "reply_markdown", "not_json")


def decide(reconciled: DataFrame, options: Options) -> DataFrame:
    """Results with band, markdown and vlm_attempted: the status that each document takes."""
    lost = F.col("total_failure") & (F.col("band") == "invoice") & F.col("markdown").isNotNull()
    model = F.lit(options.model_enabled) & ~F.coalesce(F.col("vlm_attempted"), F.lit(False))
    status = F.when(F.col("status") == "reconciled", "committed").when(lost, "exported_markdown").when(model, "escalated_vlm").otherwise("pending_review")
    return reconciled.withColumn("next", status)


def induce(committed: DataFrame, options: Options) -> DataFrame:
    """Templates from committed text and image documents: doc_id, seq, ids, body, source; only useful ones. ``by``
    says whether the model, a person, a template or the rules gave the values; a template's own are not induced anew."""
    t = committed.where(F.col("lines").isNotNull() & (F.size("lines") > 0))
    source = F.when(F.col("by") == "vlm", "vlm").when(F.col("by") == "human", "human_review").when((F.col("by") == "rules") & F.lit(options.induce_from_rules), "rule_engine")
    t = t.withColumn("source", source).where(F.col("source").isNotNull())
    t = t.withColumn("body", T.induce_template(F.col("canonical"), F.col("lines"), F.col("tables"), F.col("page_count")).cast(TEMPLATE)).where(T.useful(F.col("body")))
    ids = F.struct(*[F.col(f"body.vendor_ids.{n}").alias(n) for n in ("vat_id", "tax_number", "ibans", "name_hash")])
    return t.select("doc_id", F.col("doc_id").alias("seq"), ids.alias("ids"), "body", "source")


def review(pending: DataFrame, corrections: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Corrections (doc_id, body: a canonical invoice) of stored documents (doc_id, status, lines, tables, page_count):
    for each its code and what blocks, and for accepted ones the body, which is stored as it was submitted, with the
    status that follows; and what accepted ones teach, for ``vendors.upsert``."""
    kinds = struct_type(INVOICE).fields
    loaded = corrections.withColumns({"invoice": F.struct(*[F.col("body")[f.name].alias(f.name) for f in kinds]).cast(INVOICE)})
    found = R.checks(options.reconcile)
    checked = R.load(loaded).select("doc_id", "body", F.concat(*[found[n]["violations"] for n in D.BLOCKING]).alias("solved"), canonical_issues(F.col("body")).alias("issues"))
    told = materialised(D.commit_review(pending, checked, F.col("solved"), F.col("issues")), "review")
    taken = told["code"] == 200
    answers = told.select("doc_id", "code", "blocking", F.when(taken, F.col("body")).alias("canonical"), F.when(taken, "committed").otherwise(F.col("status")).alias("status"))
    stored = answers.where("code = 200").join(pending.select("doc_id", "lines", "tables", "page_count"), "doc_id").withColumn("by", F.lit("human"))
    return answers, induce(stored, options)


@dataclass
class Ports:
    """What stands outside: ``ocr`` gives doc_id, page_count, lines and tables of a scan's words; ``model`` gives doc_id,
    is_invoice, reply_invoice, reply_markdown and not_json."""

    ocr: Port | None = None
    model: Port | None = None


@dataclass
class Result:
    """What a batch leaves: documents with their status, the templates after it, escalations (doc_id, reason) and the
    stages that each document passed (doc_id, event, detail)."""

    documents: DataFrame
    templates: DataFrame
    escalations: DataFrame
    events: DataFrame


_DONE = ("doc_id", "parent_id", "lane", "lines", "tables", "page_count", "markdown", "band", "invoice", "field_meta", "by", "attempted")


def _shaped(df: DataFrame, lane: str, by: Column | None = None, **more: Column) -> DataFrame:
    """Extracted documents of any lane, in the columns of ``_DONE``."""
    kinds = {"doc_id": "string", "parent_id": "string", "lane": "string", "lines": f"array<{LINE}>", "tables": f"array<{TABLE}>", "page_count": "int", "markdown": "string", "band": "string", "invoice": INVOICE, "field_meta": f"map<string,{META}>", "by": "string", "attempted": "boolean"}
    given = {"lane": F.lit(lane), "by": by if by is not None else F.lit(lane), "attempted": F.lit(False), **more}
    return df.select(*[(given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def _by() -> Column:
    return F.when(F.exists(F.map_values("field_meta"), lambda m: m["source"] == "template"), "template").otherwise("rules")


def reconciled(rows: DataFrame, options: Options) -> DataFrame:
    """Extracted documents solved and decided: canonical, repairs, violations and ``next``."""
    solved = R.reconcile(rows.select("doc_id", "invoice", "field_meta"), options.reconcile)
    solved = solved.select("doc_id", "status", F.col("invoice").alias("canonical"), "repairs", "violations", "total_failure")
    joined = rows.drop("invoice", "field_meta").join(solved, "doc_id").withColumn("vlm_attempted", F.col("attempted"))
    return decide(joined, options).drop("status", "total_failure", "vlm_attempted")


def run_batch(docs: DataFrame, templates: DataFrame, options: Options | None = None, lexicon: L.Lexicon = L.DEFAULT, words=G.WORDS, ports: Ports | None = None) -> Result:
    """Documents (doc_id, page_count, lines, tables, markdown) to statuses, and the template table (template_id, ids,
    body, version, source) with what the batch taught.

    Where ``docs`` also holds attachments (name, content) and characters, the number found on the first pages, each
    document takes its route: e-invoices are read, and fall through to the text lane where that fails; scans, and texts
    that the gate refuses, go to the image lane with the words of ``ports.ocr``; what stays uncertain, unsolved or
    unknown is put to ``ports.model`` once, where options enable it, and solved again. The invoices of a document of
    several are documents of their own, with its id as ``parent_id``. Without a port its documents wait for review, or
    with the status that asks for it."""
    options, ports = options or Options(), ports or Ports()
    if "parent_id" not in docs.columns:
        docs = docs.withColumn("parent_id", F.lit(None).cast("string"))
    taken = {"attachments", "characters"} <= set(docs.columns)
    routed = docs.withColumn("route", route(F.transform("attachments", lambda a: a["name"]), F.col("characters"), options) if taken else F.lit("text"))
    routed = materialised(routed, "routed")
    known = templates.withColumn("template", F.col("body"))
    told = [routed.select("doc_id", F.lit("routed").alias("event"), F.to_json(F.struct("route")).alias("detail"))]
    raised = []

    texts, extracted = routed.where("route = 'text'").drop("attachments"), []
    if taken and not routed.where("route = 'zugferd'").isEmpty():
        xml = materialised(xml_lane(routed.where("route = 'zugferd'")), "xml")
        raised.append(D.escalations(xml, F.col("reason")))
        extracted.append(_shaped(xml.where("next = 'extracted'"), "zugferd", lines=F.lit(None), tables=F.lit(None)))
        texts = texts.unionByName(xml.where("next = 'text'").select(*texts.columns))

    laned = materialised(text_lane(texts.drop("route", "characters"), options, words), "laned")
    if not laned.where("next = 'segmented'").isEmpty():
        own = materialised(text_lane(segment_children(laned), options, words), "children")
        laned = laned.unionByName(own, allowMissingColumns=True)
    told.append(laned.select("doc_id", F.lit("text_gate").alias("event"), F.to_json(F.struct("gate.verdict")).alias("detail")))
    told.append(laned.select("doc_id", F.lit("classified").alias("event"), F.to_json(F.struct("class.band")).alias("detail")))
    text = materialised(extract(laned.where("next = 'extract'"), known, lexicon), "extracted")
    extracted.append(_shaped(text, "text", _by(), band=F.col("class.band")))

    waiting = laned.where("next NOT IN ('extract', 'image', 'escalated_vlm')").select("doc_id", "parent_id", "markdown", F.col("next").alias("status"))
    model = [laned.where("next = 'escalated_vlm'")]
    scans = laned.where("next = 'image'").select("doc_id", "parent_id", "markdown").unionByName(routed.where("route = 'image'").select("doc_id", "parent_id", "markdown"))
    if ports.ocr is None:
        waiting = waiting.unionByName(scans.withColumn("status", F.lit("image")))
    else:
        scans = materialised(scans, "scans")
        seen = materialised(image_lane(scans.join(ports.ocr(scans), "doc_id"), known, options), "image")
        extracted.append(_shaped(seen.where("next = 'extracted'"), "image", F.lit("template")))
        model.append(seen.where("next = 'escalated_vlm'"))
        waiting = waiting.unionByName(seen.where("next = 'pending_review'").select("doc_id", "parent_id", "markdown", F.lit("pending_review").alias("status")))

    rows = extracted[0]
    for more in extracted[1:]:
        rows = rows.unionByName(more)
    first = materialised(reconciled(rows, options), "decided")
    done = first
    asked = first.where("next = 'escalated_vlm'").select("doc_id", "parent_id", "lines", "tables", "page_count", "markdown")
    for m in model:
        asked = asked.unionByName(m.select("doc_id", "parent_id", "lines", "tables", "page_count", "markdown"), allowMissingColumns=True)
    raised.append(D.escalations(asked, F.lit("to_model")))
    if ports.model is not None and options.model_enabled:
        asked = materialised(asked, "asked")
        said = materialised(ask_model(asked, ports.model), "replies")
        waiting = waiting.unionByName(said.where("next = 'exported_markdown'").select("doc_id", "parent_id", "markdown", F.col("next").alias("status")))
        again = reconciled(_shaped(said.where("next = 'extracted'"), "image", F.lit("vlm"), attempted=F.lit(True), band=F.lit("invoice")), options)
        done = first.where("next <> 'escalated_vlm'").unionByName(materialised(again, "solved-again"))
    else:
        waiting = waiting.unionByName(laned.where("next = 'escalated_vlm'").select("doc_id", "parent_id", "markdown", F.col("next").alias("status")))
    told.append(done.select("doc_id", F.lit("reconciled").alias("event"), F.to_json(F.struct(F.col("next").alias("status"))).alias("detail")))
    raised.append(D.escalations(done.where("next = 'pending_review'"), F.array_join(F.transform("violations", lambda v: v["constraint"]), ",")))

    taught = materialised(induce(done.where("next = 'committed' AND lane <> 'zugferd'"), options), "induced")
    columns = ("doc_id", "parent_id", "canonical", "repairs", "violations", "markdown")
    rest = waiting.select("doc_id", "parent_id", *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in columns[2:5]], "markdown", "status")
    documents = done.select(*columns, F.col("next").alias("status")).unionByName(rest)

    def together(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    return Result(documents, V.upsert(templates, taught), together(raised), together(told))
