"""Amounts, dates, labels, the text gate, the classifier and the rules, over texts rendered from orders or over
``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import dates as D
from ..functions import identity as I
from ..functions import text as T
from ..operators import classify as C
from ..operators import gate as G
from ..operators import rules as L
from ..plans.schemas import LINE, TABLE
from . import query, read, spread

AMOUNT_SQL = """WITH a AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
r AS (SELECT k, CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS dot, format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS en FROM a),
x AS (SELECT k, dot, en, replace(replace(replace(en, ',', '_'), '.', ','), '_', '.') AS de FROM r)
"""


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, dot (a dot-decimal string), en and de."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("dot"))
    return spread(o).withColumns({"en": A.render_amount("dot", "."), "de": A.render_amount("dot", ",")})


@query(AMOUNT_SQL + """SELECT k, en, de, replace(en, ',', '') AS en_plain, replace(de, '.', '') AS de_plain, dot AS from_en, dot AS from_de, dot AS from_euro, dot AS pinned, '-' || dot AS negative FROM x""")
def amount_render_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = amounts(spark, sf_dir)
    euro = A.parse_amount(F.concat(F.lit("EUR "), F.col("de"), F.lit(" €")))
    return x.select("k", "en", "de", A.render_amount("dot", ".", False).alias("en_plain"), A.render_amount("dot", ",", False).alias("de_plain"), A.parse_amount("en").alias("from_en"), A.parse_amount("de").alias("from_de"), euro.alias("from_euro"), A.parse_amount("de", F.lit(",")).alias("pinned"), A.parse_amount(F.concat(F.lit("- "), F.col("en"))).alias("negative"))


@query(AMOUNT_SQL + """SELECT k, CAST(NULL AS VARCHAR) AS two, CAST(NULL AS VARCHAR) AS rate_and_amount, dot AS grouped, dot AS with_prose, CAST(NULL AS VARCHAR) AS prose_with_dot FROM x""")
def amount_refuse_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two amounts side by side are refused; groups between spaces and a word behind are not."""
    x = amounts(spark, sf_dir)
    spaced = F.replace(F.col("de"), F.lit("."), F.lit(" "))
    parse = {
        "two": F.concat_ws(" ", "de", "de"),
        "rate_and_amount": F.concat(F.lit("19% "), F.col("de")),
        "grouped": spaced,
        "with_prose": F.concat(F.col("de"), F.lit(" netto")),
        "prose_with_dot": F.concat(F.col("de"), F.lit(" inkl. MwSt")),
    }
    pinned = {"prose_with_dot": F.lit(",")}
    return x.select("k", *[A.parse_amount(v, pinned.get(n)).alias(n) for n, v in parse.items()])


@query(AMOUNT_SQL + """, y AS (SELECT k, CASE k % 5 WHEN 0 THEN en WHEN 1 THEN de WHEN 2 THEN split_part(en, '.', 1) WHEN 3 THEN split_part(de, ',', 1) || ',5' ELSE en || '9' END AS s FROM x)
SELECT k, s, CASE WHEN regexp_matches(s, '[.,][0-9]{1,2}$') THEN CASE WHEN regexp_matches(s, '[.][0-9]{1,2}$') THEN '.' ELSE ',' END END AS separator FROM y""")
def separator_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = amounts(spark, sf_dir), F.col("k") % 5
    s = F.when(k == 0, F.col("en")).when(k == 1, F.col("de")).when(k == 2, F.substring_index("en", ".", 1)).when(k == 3, F.concat(F.substring_index("de", ",", 1), F.lit(",5"))).otherwise(F.concat("en", F.lit("9")))
    return x.select("k", s.alias("s")).withColumn("separator", A.detect_separator("s"))


@query("""WITH d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k, CASE k % 8 WHEN 0 THEN strftime(d, '%d.%m.%Y') WHEN 1 THEN strftime(d, '%-d.%-m.%Y') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%d/%m/%Y')
 WHEN 4 THEN strftime(d, '%-d. %B %Y') WHEN 5 THEN strftime(d, '%B %-d, %Y') WHEN 6 THEN strftime(d, '%d.%m.%y') ELSE strftime(d, '%m/%d/%Y') || ' 10:00' END AS printed,
 CASE WHEN k % 8 = 7 OR year(d) < 1990 OR year(d) > 2100 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS iso FROM d""")
def date_render_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    printed = F.concat(D.render_date("d", "MM/dd/yyyy"), F.lit(" 10:00"))
    for i, fmt in reversed(list(enumerate(D.FORMATS))):
        printed = F.when(F.col("k") % 8 == i, D.render_date("d", fmt)).otherwise(printed)
    return o.select("k", printed.alias("printed")).withColumn("iso", D.parse_date("printed"))


@query("""SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9%]', '', 'g') AS label FROM documents""")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_label("text").alias("label"))


_WORD_LIST = ", ".join(f"'{w}'" for w in G.WORDS)
_PART_LIST = "|".join(w for w in G.WORDS if G.PART[0] <= len(w) <= G.PART[1])
GATE_SQL = f"""WITH t AS (SELECT doc_id, text, list_transform(list_filter(regexp_split_to_array(text, '[^\\p{{L}}]+'), lambda x: x <> ''), lambda x: strip_accents(replace(lower(x), 'ß', 'ss'))) AS tokens FROM documents),
c AS (SELECT doc_id, text, len(tokens) AS n, len(list_filter(tokens, lambda x: length(x) = 1)) AS single, len(list_filter(tokens, lambda x: length(x) >= 4)) AS considered,
 len(list_filter(tokens, lambda x: length(x) >= 4 AND (x IN ({_WORD_LIST}) OR (length(x) >= 6 AND regexp_matches(x, '{_PART_LIST}'))))) AS hits FROM t)
"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", G.text_gate(F.col("text")).alias("g"))


@query(GATE_SQL + "SELECT doc_id, considered, CAST(CASE WHEN considered >= 10 THEN round(hits / considered, 6) END AS DOUBLE) AS hit_rate FROM c")
def dict_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("doc_id", "g.considered", F.round("g.hit_rate", 6).alias("hit_rate"))


@query(GATE_SQL + """SELECT doc_id, CASE WHEN (n >= 10 AND single > 0.4 * n) OR (considered >= 10 AND hits < 0.55 * considered) OR regexp_matches(text, '\\(cid:[0-9]+\\)') THEN 'garbage' ELSE 'ok' END AS verdict,
 CAST((n >= 10 AND single > 0.4 * n) AS INTEGER) + CAST((considered >= 10 AND hits < 0.55 * considered) AS INTEGER) + CAST(regexp_matches(text, '\\(cid:[0-9]+\\)') AS INTEGER) AS n_reasons FROM c""")
def text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("doc_id", "g.verdict", F.size("g.reasons").alias("n_reasons"))


#: Rendered invoices: the lines of an order's page, as SQL and as Columns.
PAGE_SQL = AMOUNT_SQL + """, o AS (SELECT x.k, x.de, x.en, CAST(o_orderdate AS DATE) AS d, k % 4 AS style, k % 3 AS kind FROM x JOIN orders ON o_orderkey = x.k),
p AS (SELECT k, style, kind, de, en, d, list_filter([
 CASE WHEN kind = 0 THEN 'Rechnung' WHEN kind = 1 THEN 'Invoice' ELSE 'Lieferschein' END,
 CASE style WHEN 0 THEN 'Rechnungsnummer: R-' || k || '-A' WHEN 1 THEN 'Invoice No. INV/' || k WHEN 2 THEN 'Unsere Nummer ' || k ELSE 'Rechnung ' || k END,
 CASE style WHEN 0 THEN 'Rechnungsdatum ' || strftime(d, '%d.%m.%Y') WHEN 1 THEN 'Invoice Date: ' || strftime(d, '%Y-%m-%d') WHEN 2 THEN 'Datum: ' || strftime(d, '%d/%m/%Y') END,
 CASE WHEN style < 2 THEN 'Zwischensumme (netto) ' || de WHEN style = 2 THEN 'Net Total: ' || en ELSE 'Netto' END,
 CASE style WHEN 0 THEN 'MwSt. 19' || chr(160) || '%:' || chr(8239) || de WHEN 1 THEN 'VAT 7 % ' || en WHEN 2 THEN 'USt-IdNr. DE136695976' ELSE 'MwSt 5 % 1,00' END,
 CASE style WHEN 0 THEN 'Gesamtbetrag: ' || de || ' EUR' WHEN 1 THEN 'Total Due $ ' || en WHEN 2 THEN 'Zahlbetrag ' || de ELSE 'Gesamt' END], lambda x: x IS NOT NULL) AS lines FROM o)
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, style, kind, de, en, lines (an array of line structs) and tables."""
    x = amounts(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    o = x.join(o, "k").withColumns({"style": F.col("k") % 4, "kind": F.col("k") % 3})
    k, de, en, d, style = F.col("k").cast("string"), F.col("de"), F.col("en"), F.col("d"), F.col("style")

    def by_style(*values: Column | None) -> Column:
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            if v is not None:
                out = F.when(style == i, v).otherwise(out)
        return out

    def said(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    texts = F.array(
        F.when(F.col("kind") == 0, "Rechnung").when(F.col("kind") == 1, "Invoice").otherwise("Lieferschein"),
        by_style(said("Rechnungsnummer: R-", k, "-A"), said("Invoice No. INV/", k), said("Unsere Nummer ", k), said("Rechnung ", k)),
        by_style(said("Rechnungsdatum ", D.render_date(d, "dd.MM.yyyy")), said("Invoice Date: ", d), said("Datum: ", D.render_date(d, "dd/MM/yyyy")), None),
        by_style(said("Zwischensumme (netto) ", de), said("Zwischensumme (netto) ", de), said("Net Total: ", en), F.lit("Netto")),
        by_style(said("MwSt. 19\u00a0%:\u202f", de), said("VAT 7 % ", en), F.lit("USt-IdNr. DE136695976"), F.lit("MwSt 5 % 1,00")),
        by_style(said("Gesamtbetrag: ", de, " EUR"), said("Total Due $ ", en), said("Zahlbetrag ", de), F.lit("Gesamt")),
    )

    def line(t: Column, i: Column) -> Column:
        y = i * 0.1 + 0.05
        box = F.struct(F.lit(0.1).alias("x0"), y.alias("y0"), F.lit(0.9).alias("x1"), (y + 0.02).alias("y1"))
        return F.struct(i.cast("int").alias("ix"), t.alias("text"), F.lit(1).alias("page"), box.alias("box"), F.lit(None).cast("string").alias("tag"), F.array().cast("array<struct<text:string,page:int,box:struct<x0:double,y0:double,x1:double,y1:double>>>").alias("tokens"))

    lines = F.transform(F.filter(texts, lambda t: t.isNotNull()), line)
    rows = F.array(F.array(F.lit("1"), F.lit("Ware"), de), F.array(F.lit("2"), F.lit("Fracht"), F.when(style == 3, F.lit("x")).otherwise(en)))
    box = F.struct(*[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.5, 1.0, 0.7), strict=True)])
    table = F.struct(F.lit(1).alias("page"), box.alias("box"), F.array(F.lit("Pos"), F.lit("Bezeichnung"), F.lit("Betrag")).alias("header"), rows.alias("rows"))
    tables = F.when(style < 3, F.array(table)).otherwise(F.array().cast(f"array<{TABLE}>"))
    return o.select("k", "style", "kind", "de", "en", "dot", "d", lines.cast(f"array<{LINE}>").alias("lines"), tables.cast(f"array<{TABLE}>").alias("tables"))


@query(PAGE_SQL + """, f AS (SELECT k, CAST(len(list_filter(lines, lambda l: regexp_matches(l, '(?i)\\b(rechnung|invoice|gutschrift|credit\\s?note)\\b') AND list_position(lines, l) <= 3)) > 0 AS INTEGER) AS heading_keyword,
 CAST(len(list_filter(lines, lambda l: regexp_matches(l, '(?i)(rechnungs?-?\\s?(nr|nummer)|invoice\\s?(no|number|#)|beleg-?(nr|nummer))') AND regexp_matches(l, '[A-Za-z]{0,4}[-/]?[0-9][0-9A-Za-z\\-/._]{2,}'))) > 0 AS INTEGER) AS number_pattern,
 CAST(style = 2 AS INTEGER) AS tax_id, CAST(style IN (0, 1) AND year(d) BETWEEN 1990 AND 2100 AS INTEGER) AS labelled_date,
 CAST(style IN (0, 1) AS INTEGER) AS vat_block, CAST(style < 3 AS INTEGER) AS amount_table FROM p)
SELECT *, 3 * heading_keyword + 2 * number_pattern + 2 * tax_id + labelled_date + 2 * vat_block + 2 * amount_table AS score,
 CASE WHEN 3 * heading_keyword + 2 * number_pattern + 2 * tax_id + labelled_date + 2 * vat_block + 2 * amount_table >= 7 THEN 'invoice'
 WHEN 3 * heading_keyword + 2 * number_pattern + 2 * tax_id + labelled_date + 2 * vat_block + 2 * amount_table <= 3 THEN 'non_invoice' ELSE 'uncertain' END AS band FROM f""")
def classify_score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pages(spark, sf_dir).select("k", C.classify(F.col("lines"), F.col("tables")).alias("c"))
    return c.select("k", *[F.element_at("c.features", F.lit(n)).alias(n) for n in ("heading_keyword", "number_pattern", "tax_id", "labelled_date", "vat_block", "amount_table")], "c.score", "c.band")


@query(PAGE_SQL + """SELECT p.k, CASE p.style WHEN 0 THEN 'R-' || p.k || '-A' WHEN 1 THEN 'INV/' || p.k WHEN 3 THEN CASE WHEN p.k >= 10 THEN CAST(p.k AS VARCHAR) END END AS invoice_number,
 CASE WHEN p.style < 3 AND year(d) BETWEEN 1990 AND 2100 THEN strftime(d, '%Y-%m-%d') END AS issue_date, CASE WHEN p.style = 2 THEN x.dot END AS net,
 CASE p.style WHEN 0 THEN x.dot WHEN 1 THEN x.dot WHEN 3 THEN '1.00' END AS tax,
 CASE p.style WHEN 0 THEN x.dot WHEN 1 THEN x.dot WHEN 2 THEN x.dot END AS gross FROM p JOIN x USING (k)""")
def label_anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = pages(spark, sf_dir).select("k", L.header_fields(F.col("lines")).alias("h"))
    return hits.select("k", *[F.col(f"h.{f}.value").alias(f) for f in ("invoice_number", "issue_date", "net", "tax", "gross")])


@query(PAGE_SQL + """SELECT p.k, CAST(CASE p.style WHEN 0 THEN 19 WHEN 1 THEN 7 ELSE 5 END AS INTEGER) AS rate, CASE WHEN p.style = 3 THEN '1.00' ELSE x.dot END AS tax FROM p JOIN x USING (k) WHERE p.style <> 2""")
def vat_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pages(spark, sf_dir).select("k", F.explode(L.vat_lines(F.col("lines"))).alias("v"))
    return v.select("k", F.col("v.rate").cast("int").alias("rate"), "v.tax")


@query(PAGE_SQL + "SELECT k, CASE style WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency FROM p")
def currency_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("k", L.currency(F.array_join(F.transform("lines", lambda x: x["text"]), " ")).alias("currency"))


@query("""WITH s AS (SELECT s_suppkey AS k, lpad(CAST((s_suppkey * 7919 + 12345) % 100000000 AS VARCHAR), 8, '0') AS body FROM supplier),
c AS (SELECT k, body, list_reduce(list_prepend(10, list_transform(string_split(body, ''), lambda x: CAST(x AS INTEGER))), lambda p, d: ((CASE WHEN (p + d) % 10 = 0 THEN 10 ELSE (p + d) % 10 END) * 2) % 11) AS p FROM s),
v AS (SELECT k, 'DE' || body || CAST(((11 - p) % 10 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS vat_id FROM c)
SELECT k, vat_id, k % 3 <> 0 AS valid FROM v""")
def vat_id_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a right check digit, but for keys divisible by 3."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lpad(((F.col("s_suppkey") * 7919 + 12345) % 100_000_000).cast("string"), 8, "0").alias("body"))
    candidates = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.lit("DE"), F.col("body"), d.cast("string")))
    right = F.array_position(F.transform(candidates, I.valid_vat_id), F.lit(True)) - 1
    digit = (right + F.when(F.col("k") % 3 == 0, 1).otherwise(0)) % 10
    made = F.concat(F.lit("DE"), F.col("body"), digit.cast("string"))
    return s.select("k", made.alias("vat_id")).withColumn("valid", I.valid_vat_id("vat_id"))


IBAN_SQL = """WITH s AS (SELECT s_suppkey AS k, lpad(CAST(37040044 AS VARCHAR), 8, '0') || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS body FROM supplier),
i AS (SELECT k, body, 98 - CAST(CAST(body || '131400' AS HUGEINT) % 97 AS INTEGER) AS c FROM s),
v AS (SELECT k, 'DE' || lpad(CAST(CASE WHEN k % 4 = 0 THEN (c + 1) % 97 + 2 ELSE c END AS VARCHAR), 2, '0') || body AS iban, CASE WHEN k % 4 = 0 THEN ((c + 1) % 97 + 2) % 97 = c % 97 ELSE true END AS valid FROM i)
"""


def ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys and account numbers, with wrong check digits for keys divisible by 4."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("37040044"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias("body"))
    check = F.lit(98) - (F.concat("body", F.lit("131400")).cast("decimal(38,0)") % 97).cast("int")
    wrong = (check + 1) % 97 + 2
    digits = F.lpad(F.when(F.col("k") % 4 == 0, wrong).otherwise(check).cast("string"), 2, "0")
    return s.select("k", F.concat(F.lit("DE"), digits, F.col("body")).alias("iban"))


@query(IBAN_SQL + "SELECT * FROM v")
def iban_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.regexp_replace("iban", "(.{4})", "$1 ")
    return ibans(spark, sf_dir).select("k", "iban", I.valid_iban(F.lower(spaced)).alias("valid"))


@query("""WITH n AS (SELECT s_suppkey AS k, replace(regexp_replace(strip_accents(lower(s_name)), '[^a-z0-9%]', '', 'g'), 'gmbh', '') || '|' || lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS s FROM supplier)
SELECT k, lower(lpad(hex(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(s, ''), lambda c: CAST(ord(c) AS UBIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) AS hash FROM n""")
def name_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), I.vendor_name_hash("s_name", F.lpad(F.col("s_nationkey").cast("string"), 5, "0")).alias("hash"))
