"""Templates applied and learnt, scans, layout JSON, headings and identifiers, over pages rendered from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions.dates import render_date
from ..operators import layout as Y
from ..operators import line_items as N
from ..operators import rules as L
from ..operators import template as T
from ..plans.schemas import CANONICAL, FIELD, ITEM_TABLE, LINE, TABLE, TEMPLATE, VENDOR_IDS, struct_type
from ..sources import ports as P
from . import layouts, query, read, spread
from .texts import AMOUNT_SQL, amounts

ORDERS_SQL = AMOUNT_SQL + ", o AS (SELECT x.k, x.dot, x.en, x.de, CAST(o_orderdate AS DATE) AS d FROM x JOIN orders ON o_orderkey = x.k)\n"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, dot, en, de and d, an ISO date."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return amounts(spark, sf_dir).join(o, "k")


def _box(x0: float, y0: float, x1: float, y1: float) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def _line(text, y: float, page: int = 1, x0: float = 0.1, x1: float = 0.9, words: list[tuple[object, float]] | None = None) -> Column:
    """A line with its words as tokens at the places given, each 0.08 wide."""
    text = F.lit(text) if isinstance(text, str) else text
    tokens = F.array(*[F.struct((F.lit(w) if isinstance(w, str) else w).alias("text"), F.lit(page).alias("page"), _box(x, y, x + 0.08, y + 0.02).alias("box")) for w, x in words or []])
    return F.struct(F.lit(0).alias("ix"), text.alias("text"), F.lit(page).alias("page"), _box(x0, y, x1, y + 0.02).alias("box"), F.lit(None).cast("string").alias("tag"), tokens.alias("tokens")).cast(LINE)


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _field(label: Column | None, pattern: str | None, page: int, box: Column | None) -> Column:
    none = F.lit(None)
    return F.struct((none if label is None else label).alias("label"), F.lit(pattern).alias("value_pattern"), F.lit(page).alias("page"), (none if box is None else box).alias("box")).cast(FIELD)


def _template(fields: dict[str, Column], table: Column | None = None, decimal: str = ",") -> Column:
    ids = F.struct(F.lit("DE811907980").alias("vat_id"), F.lit(None).alias("tax_number"), F.array(F.lit("DE1")).alias("ibans"), F.lit("h").alias("name_hash"), F.lit("ACME").alias("display_name")).cast(VENDOR_IDS)
    made = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]) if fields else F.create_map().cast(f"map<string,{FIELD}>")
    own = F.lit(None).cast(ITEM_TABLE) if table is None else table.cast(ITEM_TABLE)
    return F.struct(F.lit(1).alias("template_version"), ids.alias("vendor_ids"), F.lit(decimal).alias("decimal"), F.array(F.lit("dd.MM.yyyy")).alias("date_formats"), made.alias("fields"), own.alias("item_table")).cast(TEMPLATE)


@query(ORDERS_SQL + """SELECT k, 'R-' || k AS number, CAST(CASE WHEN k % 5 = 0 THEN 0.3 ELSE 0.95 END AS DOUBLE) AS number_rung, strftime(d, '%Y-%m-%d') AS issued, 0.75 AS issued_rung,
 dot AS gross, CAST(CASE WHEN k % 3 = 0 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS gross_rung, dot AS net, 0.6 AS net_rung, '19.00' AS tax, 0.5 AS tax_rung, CASE WHEN k % 2 = 0 THEN 2 END AS due_page FROM o""")
def template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung of the ladder: region, label and pattern; region and pattern; label and pattern, the value below its
    label; label alone, in another spelling for keys divisible by 7; region alone; pattern alone. A decoy repeats the
    label of the gross away from its region, and the last page is -1."""
    k = F.col("k")
    lines = F.array(
        _line(_said("Rechnungsnummer: R-", k), 0.1),
        _line("Datum", 0.2),
        _line(render_date("d", "dd.MM.yyyy"), 0.23),
        _line("Gesamtbetrag Vorjahr: 1,00", 0.5),
        _line(_said("Summe  Netto: ", F.col("de")), 0.6),
        _line("19,00", 0.7),
        _line(_said("Gesamtbetrag: ", F.col("de"), " EUR"), 0.8, 2),
        _line("Zahlbar bis 01.02.2003", 0.9, 2),
    )
    number = F.when(k % 5 == 0, _field(None, r"R-[0-9]+", 1, None)).otherwise(_field(F.lit("Rechnungsnummer"), r"R-[0-9]+", 1, _box(0.1, 0.1, 0.9, 0.12)))
    gross = F.when(k % 3 == 0, _field(None, r"-?[0-9.]+,[0-9]{2}", -1, _box(0.1, 0.8, 0.9, 0.82))).otherwise(_field(F.lit("Gesamtbetrag"), r"-?[0-9.,]+", -1, _box(0.1, 0.8, 0.9, 0.82)))
    net = _field(F.when(k % 7 == 0, "summe-netto").otherwise("Netto"), None, 1, None)
    due = F.when(k % 2 == 0, _field(F.lit("Zahlbar bis"), r"[0-9.]+", -1, _box(0.1, 0.9, 0.9, 0.92))).otherwise(_field(F.lit("Zahlbar bis"), r"[0-9.]+", 1, _box(0.1, 0.9, 0.9, 0.92)))
    t = _template({"invoice_number": number, "issue_date": _field(F.lit("Datum"), r"[0-9.]{10}", 1, None), "gross": gross, "net": net, "tax": _field(None, None, 1, _box(0.1, 0.7, 0.9, 0.72)), "due_date": due})
    none = F.array().cast(f"array<{TABLE}>")
    d = orders(spark, sf_dir).select("k", lines.alias("lines"), t.alias("t"))
    done = d.select("k", T.apply_template(F.col("t"), F.col("lines"), none, F.lit(2)).alias("a"))
    named = {"number": "invoice_number", "issued": "issue_date", "gross": "gross", "net": "net", "tax": "tax"}
    return done.select("k", *[F.col(f"a.{f}.{part}").alias(n + tail) for n, f in named.items() for part, tail in (("value", ""), ("confidence", "_rung"))], F.col("a.due_date.page").alias("due_page"))


@query(f"""WITH r AS (SELECT l_orderkey AS k, l_partkey AS part, l_linenumber % 3 = 0 AS rest, row_number() OVER (PARTITION BY l_orderkey ORDER BY {layouts.ORDER}) AS rn FROM lineitem),
g AS (SELECT k, count(*) - count_if(rest AND rn > 1) AS items, min_by(part, rn) AS part, bool_or(rest AND rn = 1) AS first_rest FROM r GROUP BY k)
SELECT k, CAST(CASE WHEN k % 4 <> 3 THEN items END AS INTEGER) AS items, CASE WHEN k % 4 <> 3 THEN CASE WHEN first_rest THEN 'more ' ELSE 'Ware ' END || part END AS starts, 0.85 AS row_confidence, 'template' AS row_source, 'ACME' AS seller, 'DE1' AS ibans FROM g""")
def template_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the table that fits the signature, rows without a number continued; no table fits every fourth order."""
    index = {"position": 0, "description": 1, "quantity": 2, "line_total": 3}
    table = F.struct(F.array(*map(F.lit, ("Pos", "Bezeichnung", "Menge", "Betrag"))).alias("header"), F.create_map(*[F.lit(x) for kv in index.items() for x in kv]).alias("columns"), F.lit(N.NO_NUMBER).alias("continuation"))
    heads = F.when(F.col("k") % 4 == 3, F.array(*map(F.lit, ("a", "b", "c", "Betrag")))).otherwise(F.array(*map(F.lit, ("Pos.", "Bezeichnung", "Menge (Stk)", "Netto"))))
    one = F.struct(F.lit(1).alias("page"), _box(0.0, 0.0, 1.0, 1.0).alias("box"), heads.alias("header"), F.col("rows").alias("rows")).cast(TABLE)
    d = layouts.tables(spark, sf_dir).select("k", F.array(one).alias("tables"), _template({}, table).alias("t"))
    a = d.select("k", T.apply_template(F.col("t"), F.array().cast(f"array<{LINE}>"), F.col("tables"), F.lit(1)).alias("a"))
    first = F.regexp_extract(F.get("a.items", F.lit(0))["description"], "^(?:Ware|more) [0-9]+", 0)
    return a.select("k", F.when(F.col("a.items").isNotNull(), F.size("a.items")).alias("items"), first.alias("starts"), "a.row_confidence", "a.row_source", F.col("a.seller.name").alias("seller"), F.array_join("a.seller.ibans", ",").alias("ibans"))


def _scan(k: Column) -> Column:
    """Words of a scan: headings, one to four rows in words that are not level, and for even keys a total and more."""
    head = [_line("Pos", 0.1, 1, 0.05, 0.1, [("Pos", 0.05)]), _line("Bezeichnung", 0.102, 1, 0.2, 0.4, [("Bezeichnung", 0.2)]), _line("Betrag", 0.099, 1, 0.7, 0.8, [("Betrag", 0.7)])]
    rows = []
    for i in range(4):
        y = 0.2 + 0.1 * i
        price = _said(F.col("k") % 1000, f",{i}0")
        words = [_line(price, y + 0.003, 1, 0.68, 0.78, [(price, 0.68)]), _line(str(i + 1), y, 1, 0.05, 0.08, [(str(i + 1), 0.05)]), _line(f"Ware {i}", y + 0.001, 1, 0.2, 0.4, [("Ware", 0.2), (str(i), 0.3)])]
        rows.append(F.when(k % 4 >= i, F.array(*words)).otherwise(F.array().cast(f"array<{LINE}>")))
    more = F.when(k % 2 == 0, F.array(_line("Gesamtbetrag", 0.7, 1, 0.2, 0.4, [("Gesamtbetrag", 0.2)]), _line("Nachsatz 1,00", 0.8, 1, 0.2, 0.4, [("Nachsatz", 0.2), ("1,00", 0.7)]))).otherwise(F.array().cast(f"array<{LINE}>"))
    return F.concat(F.array(*head), *rows, more)


@query(ORDERS_SQL + """SELECT k, CAST(k % 4 + 1 AS INTEGER) AS items, 'Ware ' || (k % 4) AS last, (k % 1000) || '.' || (k % 4) || '0' AS total, CAST(k % 4 + 1 AS INTEGER) AS position, 0.7 AS row_confidence, 'ocr' AS row_source FROM o""")
def ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a scan to lines, bands and items, up to the line of totals."""
    table = F.struct(F.array(*map(F.lit, ("Pos", "Bezeichnung", "Betrag"))).alias("header"), F.create_map(F.lit("position"), F.lit(0), F.lit("description"), F.lit(1), F.lit("line_total"), F.lit(2)).alias("columns"), F.lit(N.NO_NUMBER).alias("continuation"))
    d = spread(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))).select("k", _scan(F.col("k")).alias("lines"), _template({}, table).alias("t"))
    d = d.select("k", "t", Y.merged_lines(F.col("lines")).alias("lines"))
    done = d.select("k", T.apply_template_ocr(F.col("t"), F.col("lines"), F.lit(1)).alias("a")).withColumn("last", F.try_element_at("a.items", F.lit(-1)))
    return done.select("k", F.size("a.items").alias("items"), F.col("last.description").alias("last"), F.col("last.line_total").alias("total"), F.col("last.position").alias("position"), "a.row_confidence", "a.row_source")


@query(ORDERS_SQL + """SELECT k, CASE k % 3 WHEN 0 THEN 'description:1,line_total:3,position:0,quantity:2' WHEN 1 THEN 'description:0,quantity:1,unit_price:2' END AS columns,
 CASE k % 3 WHEN 0 THEN 'Pos Bezeichnung Menge Betrag' WHEN 1 THEN 'Artikel Qty Price' END AS header, CASE k % 3 WHEN 0 THEN 'rowsWithoutPosNumber' WHEN 1 THEN 'none' END AS continuation FROM o""")
def ocr_table_induce(spark: SparkSession, sf_dir: str) -> DataFrame:
    def head(*words: str) -> Column:
        return F.array(_line("Seite 1", 0.05, 1, 0.1, 0.2, [("Seite", 0.1), ("1", 0.2)]), *[_line(w, 0.3, 1, 0.1 + 0.2 * i, 0.2 + 0.2 * i, [(w, 0.1 + 0.2 * i)]) for i, w in enumerate(words)])

    k = F.col("k") % 3
    lines = F.when(k == 0, head("Pos", "Bezeichnung", "Menge", "Betrag")).when(k == 1, head("Artikel", "Qty", "Price")).otherwise(head("Datum", "Name", "Ort"))
    d = spread(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))).select("k", lines.alias("lines")).select("k", Y.merged_lines(F.col("lines")).alias("lines"))
    t = d.select("k", T.induce_ocr_table(F.col("lines")).alias("t"))
    return t.select("k", _mapping(F.col("t.columns")).alias("columns"), F.array_join("t.header", " ").alias("header"), "t.continuation")


def _mapping(m: Column) -> Column:
    return F.when(m.isNotNull(), F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ","))


INDUCE_SQL = ORDERS_SQL + """, i AS (SELECT *, k % 2 = 0 AS comma, k % 3 = 0 AS nameless, month(d) >= 10 AS late FROM o)
"""


def induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and what a template is learnt from: canonical, lines, tables and page_count. Even orders print amounts with a
    decimal comma; those divisible by 3 do not print their number; totals stand on the second page."""
    k = F.col("k")
    comma = k % 2 == 0
    printed = F.when(comma, F.col("de")).otherwise(F.col("en"))
    number = F.when(k % 3 == 0, F.lit("keine")).otherwise(_said("R-", k))
    lines = F.array(_line(_said("Nr: ", number), 0.1), _line(_said("Datum ", render_date("d", "dd.MM.yyyy")), 0.2), _line(_said("Brutto:", printed), 0.8, 2), _line("Zahlung sofort", 0.9, 2))

    def money(text: str) -> Column:
        return F.when(comma, text.replace(".", ",")).otherwise(text)

    rows = F.array(F.array(F.lit("1"), F.lit("Ware A"), F.lit("3"), money("6.00")), F.array(F.lit("2"), F.lit("Ware B"), F.lit("4"), money("8.00")), F.array(F.lit(""), F.lit("in Blau"), F.lit(""), F.lit("")))
    rows = F.when(k % 5 == 0, F.slice(rows, 1, 2)).otherwise(rows)
    table = F.struct(F.lit(1).alias("page"), _box(0.0, 0.3, 1.0, 0.6).alias("box"), F.array(*map(F.lit, ("Pos", "Bezeichnung", "Menge", "Betrag"))).alias("header"), rows.alias("rows"))
    other = F.struct(F.lit(2).alias("page"), _box(0.0, 0.3, 1.0, 0.6).alias("box"), F.array(F.lit("x")).alias("header"), F.array(F.array(F.lit("Ware A"))).alias("rows"))
    none = F.lit(None)

    def item(position: int, words: str, quantity: str, total: str) -> Column:
        return F.struct(F.lit(position).alias("position"), F.lit(words).alias("description"), F.lit(quantity).alias("quantity"), none.alias("unit"), none.alias("unit_price"), none.alias("tax_rate"), F.lit(total).alias("line_total"))

    kinds = {f.name: f.dataType for f in struct_type(CANONICAL).fields}
    seller = F.struct(F.lit("ACME GmbH").alias("name"), F.when(k % 4 == 0, "DE 811 907 981").otherwise("DE 811 907 980").alias("vat_id"), F.lit("12/345/67890").alias("tax_number"), F.array(F.lit("DE02 1203 0000 0000 2020 51"), F.lit("DE00")).alias("ibans"), none.alias("address"))
    values = {"invoice_number": _said("R-", k), "issue_date": F.col("d"), "totals": F.struct(none.alias("net"), none.alias("tax"), F.col("dot").alias("gross")), "seller": seller, "vat_breakdown": F.array(), "line_items": F.array(item(1, "Ware A in Blau", "3", "6.00"), item(2, "Ware B", "4", "8.00"))}
    canonical = F.struct(*[values.get(n, none).cast(t).alias(n) for n, t in kinds.items()])
    return orders(spark, sf_dir).select("k", canonical.alias("canonical"), lines.alias("lines"), F.array(other, table).cast(f"array<{TABLE}>").alias("tables"), F.lit(2).alias("page_count"))


@query(INDUCE_SQL + r"""SELECT k, CASE WHEN comma THEN ',' ELSE '.' END AS separator, 'dd.MM.yyyy' || CASE WHEN late THEN ' d.M.yyyy' ELSE '' END AS formats, CASE WHEN nameless THEN 'gross issue_date' ELSE 'gross invoice_number issue_date' END AS fields,
 CASE WHEN NOT nameless THEN 'Nr' END AS number_label, CASE WHEN NOT nameless THEN 'R-\d+' END AS number_pattern, 'Datum' AS date_label, '\d+\.\d+\.\d+' AS date_pattern, CAST(-1 AS INTEGER) AS gross_page, 'Brutto' AS gross_label, '-?[\d.,]+' AS gross_pattern, CAST(1 AS INTEGER) AS date_page, 0.2 AS date_top FROM i""")
def template_induce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separator, the date formats that the page proves, and each field's region, label and pattern."""
    t = induced(spark, sf_dir).select("k", T.induce_template(F.col("canonical"), F.col("lines"), F.col("tables"), F.col("page_count")).alias("t"))

    def field(name: str) -> Column:
        return F.try_element_at("t.fields", F.lit(name))

    number, issued, gross = field("invoice_number"), field("issue_date"), field("gross")
    return t.select(
        "k", F.col("t.decimal").alias("separator"), F.array_join("t.date_formats", " ").alias("formats"), F.array_join(F.array_sort(F.map_keys("t.fields")), " ").alias("fields"),
        number["label"].alias("number_label"), number["value_pattern"].alias("number_pattern"), issued["label"].alias("date_label"), issued["value_pattern"].alias("date_pattern"),
        gross["page"].alias("gross_page"), gross["label"].alias("gross_label"), gross["value_pattern"].alias("gross_pattern"), issued["page"].alias("date_page"), F.round(issued["box"]["y0"], 6).alias("date_top"),
    )


@query(INDUCE_SQL + """SELECT k, 'description:1,line_total:3,position:0,quantity:2' AS columns, 'Pos Bezeichnung Menge Betrag' AS header, CASE WHEN k % 5 = 0 THEN 'none' ELSE 'rowsWithoutPosNumber' END AS continuation,
 CASE WHEN k % 4 <> 0 THEN 'DE811907980' END AS vat_id, '12/345/67890' AS tax_number, 'DE02120300000000202051' AS ibans, 'ACME GmbH' AS display_name, true AS useful FROM i""")
def template_induce_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table by votes, from the table with the most descriptions, and the identifiers that hold."""
    t = induced(spark, sf_dir).select("k", T.induce_template(F.col("canonical"), F.col("lines"), F.col("tables"), F.col("page_count")).alias("t"))
    ids = F.col("t.vendor_ids")
    return t.select("k", _mapping(F.col("t.item_table.columns")).alias("columns"), F.array_join("t.item_table.header", " ").alias("header"), F.col("t.item_table.continuation").alias("continuation"), ids["vat_id"].alias("vat_id"), ids["tax_number"].alias("tax_number"), F.array_join(ids["ibans"], ",").alias("ibans"), ids["display_name"].alias("display_name"), T.useful(F.col("t")).alias("useful"))


@query(ORDERS_SQL + """SELECT k, CASE k % 5 WHEN 0 THEN 'position:0,description:1,quantity:2,line_total:3' WHEN 1 THEN 'description:0,unit_price:1' WHEN 2 THEN 'description:1,quantity:2,unit_price:3,tax_rate:4,line_total:5' WHEN 3 THEN 'description:1,line_total:2' END AS columns FROM o""")
def column_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by synonym or containment, no column twice; null without a description or an amount. A sign alone is no
    heading."""
    k = F.col("k") % 5
    heads = (("Pos.", "Bezeichnung", "Menge", "Gesamt"), ("Artikel-Bezeichnung", "E-Preis"), ("#", "Beschreibung", "Anzahl", "Einzelpreis (EUR)", "MwSt.-Satz", "Betrag"), ("Datum", "Leistung", "Line Total", "Summe"), ("Artikel", "Ort"))
    header = F.get(F.array(*[F.array(*map(F.lit, h)) for h in heads]), k.cast("int"))
    order = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in enumerate(("position", "description", "quantity", "unit", "unit_price", "tax_rate", "line_total"))])
    c = orders(spark, sf_dir).select("k", L.classify_columns(header).alias("c"))
    at = F.create_map(*[F.lit(x) for i, n in enumerate(N.COLUMNS) for x in (n, i)])
    told = F.filter(F.transform(order, lambda o: F.concat_ws(":", o["n"], F.get("c", F.element_at(at, o["n"])).cast("string"))), lambda s: s.contains(":"))
    return c.select("k", F.when(F.col("c").isNotNull(), F.array_join(told, ",")).alias("columns"))


LAYOUT_JSON = """{"pages":%s,"texts":[{"label":"text","text":" second ","prov":[{"page_no":1,"bbox":{"l":60,"t":400,"r":120,"b":392,"coord_origin":"BOTTOMLEFT"}}]},{"label":"title","orig":"R-%s","prov":[{"page_no":1,"bbox":{"l":60,"t":80,"r":120,"b":96}}]},
{"label":"text","text":"  ","prov":[{"page_no":1,"bbox":{"l":1,"t":1,"r":2,"b":2}}]},{"label":"text","text":"unplaced"},{"label":"text","text":"over page","prov":[{"page_no":2,"bbox":{"l":0,"t":0,"r":%s,"b":20}}]}],
"tables":[{"prov":[{"page_no":1,"bbox":{"l":0,"t":200,"r":300,"b":300}}],"data":{"num_rows":4,"num_cols":3,"table_cells":[{"text":"Ware","start_row_offset_idx":0,"end_row_offset_idx":1,"start_col_offset_idx":0,"end_col_offset_idx":2,"column_header":true},{"text":"Preis","start_row_offset_idx":0,"start_col_offset_idx":2,"column_header":true},
{"text":"Nr","start_row_offset_idx":1,"start_col_offset_idx":0,"column_header":true},{"text":"EUR","start_row_offset_idx":1,"start_col_offset_idx":2,"column_header":true},{"text":"a","start_row_offset_idx":2,"start_col_offset_idx":0},{"text":"b","start_row_offset_idx":2,"end_row_offset_idx":9,"start_col_offset_idx":1},{"text":"%s","start_row_offset_idx":3,"start_col_offset_idx":2},{"text":"c","start_row_offset_idx":3,"start_col_offset_idx":1}]}},
{"prov":[{"page_no":2,"bbox":{"l":0,"t":0,"r":60,"b":80}}],"data":{"num_rows":2,"num_cols":1,"table_cells":[{"text":"no flag","start_row_offset_idx":0,"start_col_offset_idx":0},{"text":"x","start_row_offset_idx":1,"start_col_offset_idx":0}]}},{"prov":[],"data":{"num_rows":1,"num_cols":1,"table_cells":[]}}]}"""


@query(ORDERS_SQL + """SELECT k, CAST(CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END AS INTEGER) AS page_count, 'title R-' || k || '|text second|text over page' AS lines, CAST(CASE WHEN k % 3 = 0 THEN 0.1 ELSE round(80 / 841.89, 6) END AS DOUBLE) AS top,
 CAST(CASE WHEN k % 3 = 0 THEN 0.5 ELSE round((841.89 - 400) / 841.89, 6) END AS DOUBLE) AS flipped, CAST(CASE WHEN k % 3 = 2 THEN NULL ELSE CASE WHEN k % 3 = 0 THEN 1.0 ELSE round(590 / 595.276, 6) END END AS DOUBLE) AS clamped, CAST(CASE WHEN k % 3 = 0 THEN 0.5 ELSE round(300 / 595.276, 6) END AS DOUBLE) AS table_right,
 'Ware Nr,Ware,Preis EUR' AS header, 'a,b,;,b c,' || dot AS rows, 'no flag/x' AS unflagged, CAST(2 AS INTEGER) AS n_tables, k % 3 = 2 AS failed FROM o""")
def layout_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout JSON to lines in reading order and tables with spans and headings of two rows; page sizes are declared for
    every third order, and boxes do not fit the assumed page of another third."""
    k = F.col("k")
    pages = F.when(k % 3 == 0, '{"1":{"page_no":1,"size":{"width":600,"height":800}},"2":{"page_no":3,"size":{"width":600,"height":800}}}').otherwise('{"1":{"page_no":1},"2":{"page_no":2}}')
    right = F.when(k % 3 == 0, "700").when(k % 3 == 1, "590").otherwise("700")
    d = P.read_layout(orders(spark, sf_dir).select("k", F.format_string(LAYOUT_JSON, pages, k.cast("string"), right, F.col("dot")).alias("layout_json")))
    first, last = F.get("tables", F.lit(0)), F.get("tables", F.lit(1))
    told = F.transform("lines", lambda x: F.concat_ws(" ", x["tag"], x["text"]))

    def edge(i: int, name: str) -> Column:
        return F.round(F.get("lines", F.lit(i))["box"][name], 6)

    return d.select(
        "k", "page_count", F.array_join(told, "|").alias("lines"), edge(0, "y0").alias("top"), edge(1, "y0").alias("flipped"), edge(2, "x1").alias("clamped"), F.round(first["box"]["x1"], 6).alias("table_right"),
        F.array_join(first["header"], ",").alias("header"), F.array_join(F.transform(first["rows"], lambda r: F.array_join(r, ",")), ";").alias("rows"),
        F.concat_ws("/", F.array_join(last["header"], ","), F.array_join(F.flatten(last["rows"]), ",")).alias("unflagged"), F.size("tables").alias("n_tables"), F.col("error").isNotNull().alias("failed"),
    )


@query(ORDERS_SQL + """SELECT k, CASE WHEN k % 3 <> 0 THEN 'DE811907980' END AS vat_id, CASE WHEN k % 2 = 0 THEN '12/345/67890' END AS tax_number, CASE WHEN k % 5 <> 0 THEN 'DE02120300000000202051' ELSE '' END AS ibans, 'Acme Handel' AS name_guess, lpad(CAST(10000 + k % 90000 AS VARCHAR), 5, '0') AS postal_guess, k % 2 = 0 AS plausible FROM o""")
def vendor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page tells of its vendor: checked identifiers, the first name on top and the first code of five digits."""
    k = F.col("k")
    texts = [
        (F.lit("7 Stueck"), 0.01), (F.lit("Acme Handel"), 0.05), (_said(10000 + k % 90000, " Berlin"), 0.1), (F.lit("Zweiter Name"), 0.12),
        (_said("USt-IdNr. DE 81190798", F.when(k % 3 == 0, 1).otherwise(0)), 0.3), (F.when(k % 2 == 0, "Steuernummer: 12/345/67890").otherwise("Nummer 12/345/67890"), 0.4),
        (F.when(k % 5 == 0, "IBAN DE03 1203 0000 0000 2020 51").otherwise("IBAN DE02 1203 0000 0000 2020 51"), 0.5),
    ]
    lines = F.array(*[F.struct(t.alias("text"), F.lit(y).alias("y0")) for t, y in texts])
    found = orders(spark, sf_dir).select("k", I.extract_vendor_ids(lines).alias("v"))
    return found.select("k", "v.vat_id", "v.tax_number", F.array_join("v.ibans", ",").alias("ibans"), "v.name_guess", "v.postal_guess", I.plausible_tax_number("v.tax_number").alias("plausible"))
