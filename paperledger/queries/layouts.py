"""Lines, tables, pages and boxes, laid out from order lines and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import layout as Y
from ..operators import line_items as I
from ..operators import segment as S
from ..operators import template as T
from ..plans.schemas import LINE, TABLE
from . import query, read, spread

#: Order lines in one order whatever the engine.
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query("""WITH r AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 + 1 AS INTEGER) AS page, (l_quantity * 0.005 + (l_quantity * 0.005 + 0.004)) / 2 AS y, l_quantity * 0.005 AS y0, (l_partkey % 997) / 1000.0 AS x0 FROM lineitem),
g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) <= 0.008 THEN 0 ELSE 1 END AS new FROM r),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y RANGE UNBOUNDED PRECEDING) AS grp FROM g)
SELECT doc_id, page, CAST(grp - 1 AS INTEGER) AS line, CAST(count(*) AS INTEGER) AS n, round(min(y0), 6) AS top, round(min(x0), 6) AS left_edge FROM h GROUP BY doc_id, page, grp""")
def line_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    y0, x0 = F.col("l_quantity") * 0.005, (F.col("l_partkey") % 997) / 1000.0
    rows = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page"), F.col("l_partkey").alias("ix"), F.lit("w").alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.01).alias("x1"), (y0 + 0.004).alias("y1"), F.lit(None).cast("string").alias("tag"))
    return Y.merge_lines(rows).select("doc_id", "page", "line", "n", F.round("box.y0", 6).alias("top"), F.round("box.x0", 6).alias("left_edge"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the rows of a table for each order: number, words, quantity, price, total. Every third line number is a row
    without number and amounts."""
    li = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "l_orderkey")
    rest = F.col("l_linenumber") % 3 == 0
    total = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    row = F.array(
        F.when(rest, "").otherwise(F.col("l_linenumber").cast("string")),
        F.concat(F.when(rest, "more ").otherwise("Ware "), F.col("l_partkey").cast("string")),
        F.when(rest, "").otherwise(F.col("l_quantity").cast("int").cast("string")),
        F.when(rest, "").otherwise(F.replace(total, F.lit("."), F.lit(","))),
    )
    keyed = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", row.alias("row"))
    whole = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(keyed)).alias("rows"))
    return whole.select("k", F.transform("rows", lambda r: r["row"]).alias("rows"))


@query(f"""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, l_linenumber % 3 = 0 AS rest, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS rn FROM lineitem),
g AS (SELECT *, sum(CASE WHEN rest AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY rn ROWS UNBOUNDED PRECEDING) AS item FROM r)
SELECT k, CAST(item - 1 AS INTEGER) AS item, string_agg(CASE WHEN rest THEN 'more ' ELSE 'Ware ' END || part, ' ' ORDER BY rn) AS description,
 CAST(min_by(CASE WHEN NOT rest THEN n END, rn) AS INTEGER) AS position, CAST(max(CASE WHEN NOT rest THEN q END) AS VARCHAR) AS quantity,
 max(CASE WHEN NOT rest THEN CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END) AS line_total FROM g GROUP BY k, item""")
def lineitem_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = {"position": 0, "description": 1, "quantity": 2, "line_total": 3}
    columns = F.array(*[F.lit(index.get(c)).cast("int") for c in I.COLUMNS])
    found = tables(spark, sf_dir).select("k", F.posexplode(I.line_items(F.col("rows"), columns, F.lit(I.NO_NUMBER))).alias("item", "x"))
    return found.select("k", "item", "x.description", "x.position", "x.quantity", "x.line_total")


PAGES_SQL = """WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations),
f AS (SELECT conv_id, page, page % 7 = 0 OR page % 7 = 6 AS attachment, page > 1 AND page % 5 = 1 AS restart, page % 3 = 1 AND NOT (page % 7 = 0 OR page % 7 = 6) AS invoice, page % 4 = 0 AS totals FROM p),
s AS (SELECT conv_id, page, attachment, 0 AS segment, totals AS saw FROM f WHERE page = 1
 UNION ALL SELECT f.conv_id, f.page, f.attachment, s.segment + CASE WHEN f.attachment <> s.attachment OR (NOT s.attachment AND NOT f.attachment AND (f.restart OR (f.invoice AND s.saw))) THEN 1 ELSE 0 END,
 f.totals OR (s.saw AND NOT (f.attachment <> s.attachment OR (NOT s.attachment AND NOT f.attachment AND (f.restart OR (f.invoice AND s.saw))))) FROM s JOIN f ON f.conv_id = s.conv_id AND f.page = s.page + 1)
"""


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, each turn a page whose lines show headings, counters and totals by its number."""
    c = spread(read(spark, sf_dir, "conversations").select("conv_id"), "conv_id").groupBy("conv_id").agg(F.count("*").cast("int").alias("page_count"))

    def lines(p: Column) -> Column:
        attached = (p % 7 == 0) | (p % 7 == 6)
        head = F.when(p % 7 == 0, "Unsere AGB").when(attached, "ALLGEMEINE\u00a0GESCHÄFTSBEDINGUNGEN").when(p % 3 == 1, "Rechnung Nr. 7").otherwise("Text")
        counter = F.when(p % 5 == 1, F.lit("SEITE\u00a01 von\u202f5")).otherwise(F.lit("Seite 2 von 5"))
        total = F.when(p % 4 == 0, F.lit("Zu zahlen: 12,00")).otherwise(F.lit("Zu zahlen"))

        def line(text: Column, y: float) -> Column:
            box = F.struct(F.lit(0.1).alias("x0"), F.lit(y).alias("y0"), F.lit(0.9).alias("x1"), F.lit(y + 0.02).alias("y1"))
            token = F.struct(text.alias("text"), p.alias("page"), box.alias("box"))
            return F.struct(F.lit(0).alias("ix"), text.alias("text"), p.alias("page"), box.alias("box"), F.lit(None).cast("string").alias("tag"), F.array(token).alias("tokens"))

        return F.array(line(head, 0.1), line(counter, 0.5), line(total, 0.9))

    return c.withColumn("lines", F.flatten(F.transform(F.sequence(F.lit(1), F.col("page_count")), lines)).cast(f"array<{LINE}>"))


@query(PAGES_SQL + "SELECT conv_id, CAST(segment AS INTEGER) AS segment, CASE WHEN bool_or(attachment) THEN 'attachment' ELSE 'invoice-candidate' END AS kind, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM s GROUP BY conv_id, segment")
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paged(spark, sf_dir).select("conv_id", S.page_features(F.col("lines"), F.col("page_count")).alias("p"))
    d = d.select("conv_id", F.posexplode(S.segments(F.col("p"))).alias("segment", "s"))
    return d.select("conv_id", "segment", "s.kind", F.array_join(F.transform("s.pages", lambda p: p.cast("string")), ",").alias("pages"))


@query(PAGES_SQL + "SELECT conv_id, CAST(count(*) AS INTEGER) AS pages, CAST(3 * count(*) AS INTEGER) AS lines, CAST(3 * count(*) * (count(*) + 1) // 2 AS BIGINT) AS numbers FROM p WHERE page % 2 = 1 GROUP BY conv_id")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.filter(F.sequence(F.lit(1), F.col("page_count")), lambda p: p % 2 == 1)
    d = paged(spark, sf_dir).withColumn("odd", odd).withColumn("kept", S.slice_lines(F.col("lines"), F.col("odd")))
    numbers = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + F.get(x["tokens"], F.lit(0))["page"])
    return d.select("conv_id", F.size("odd").alias("pages"), F.size("kept").alias("lines"), numbers.alias("numbers"))


TOKEN_SQL = f"""WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS n, (l_partkey % 100) / 100.0 AS x0, (l_partkey % 100) / 100.0 + l_quantity / 200.0 AS x1, (l_suppkey % 90) / 100.0 AS y0, (l_suppkey % 90) / 100.0 + 0.01 AS y1 FROM lineitem)
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and an array of boxes, in the order of the lines."""
    li = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "l_orderkey")
    x0, y0 = (F.col("l_partkey") % 100) / 100.0, (F.col("l_suppkey") % 90) / 100.0
    box = B.box(x0, y0, x0 + F.col("l_quantity") / 200.0, y0 + 0.01)
    keyed = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", box.alias("box"))
    whole = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(keyed)).alias("rows"))
    return whole.select("k", F.transform("rows", lambda r: r["box"]).alias("boxes"))


@query(TOKEN_SQL + """SELECT k, CAST(n AS INTEGER) AS n, CAST(CASE WHEN greatest(least(x1, 0.35), x0) - x0 > 0 AND least(x1, 0.35) - x0 > greatest(least(x1, 0.7) - greatest(x0, 0.35), x1 - greatest(x0, 0.7)) THEN 0
 WHEN least(x1, 0.7) - greatest(x0, 0.35) > x1 - greatest(x0, 0.7) THEN 1 ELSE 2 END AS INTEGER) AS band FROM t""")
def band_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.array(F.lit(0.1), F.lit(0.35), F.lit(0.7))
    t = tokens(spark, sf_dir).select("k", F.posexplode("boxes").alias("n", "b"))
    return t.select("k", (F.col("n") + 1).alias("n"), Y.band_of(F.col("b.x0"), F.col("b.x1"), starts).alias("band"))


@query(TOKEN_SQL + """, r AS (SELECT k, (k % 80) / 100.0 AS rx, (k % 70) / 100.0 AS ry FROM (SELECT DISTINCT k FROM t)),
i AS (SELECT t.k, sqrt(power((x0 + x1) / 2 - (rx + rx + 0.1) / 2, 2) + power((y0 + y1) / 2 - (ry + ry + 0.1) / 2, 2)) AS d FROM t JOIN r USING (k)
 WHERE x0 < least(1.0, rx + 0.1 + 0.05) AND greatest(0.0, rx - 0.05) < x1 AND y0 < least(1.0, ry + 0.1 + 0.05) AND greatest(0.0, ry - 0.05) < y1)
SELECT r.k, CAST(count(i.d) AS INTEGER) AS inside, round(min(i.d), 6) AS nearest FROM r LEFT JOIN i USING (k) GROUP BY r.k""")
def region_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx, ry = (F.col("k") % 80) / 100.0, (F.col("k") % 70) / 100.0
    region = B.box(rx, ry, rx + 0.1, ry + 0.1)
    t = tokens(spark, sf_dir).withColumn("region", region)
    inside = F.filter("boxes", lambda b: B.intersects(b, B.inflate(F.col("region"), T.REACH)))
    return t.withColumn("inside", inside).select("k", F.size("inside").alias("inside"), F.round(F.array_min(F.transform("inside", lambda b: B.distance(b, F.col("region")))), 6).alias("nearest"))


@query(TOKEN_SQL + """SELECT a.k, CAST(a.n AS INTEGER) AS n, round(min(b.y0), 6) AS below FROM t a LEFT JOIN t b ON b.k = a.k AND b.y0 > a.y1 - 0.005 AND b.x0 < a.x1 AND a.x0 < b.x1 GROUP BY a.k, a.n""")
def line_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform("boxes", lambda b: F.struct(F.lit(1).alias("page"), b.alias("box")))
    t = tokens(spark, sf_dir).select("k", lines.alias("lines"))
    t = t.select("k", F.posexplode(F.transform("lines", lambda x: T.line_below(x, F.col("lines"))["box"]["y0"])).alias("n", "below"))
    return t.select("k", (F.col("n") + 1).alias("n"), F.round("below", 6).alias("below"))


@query("""SELECT o_orderkey AS k, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 END AS INTEGER) AS page FROM orders""")
def template_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature Pos, Bezeichnung, Menge, Betrag: whole, three quarters, within longer headings, and too little."""
    def table(page: int, *heads: str) -> Column:
        box = F.struct(*[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 1.0, 1.0), strict=True)])
        return F.struct(F.lit(page).alias("page"), box.alias("box"), F.array(*map(F.lit, heads)).alias("header"), F.array(F.array(F.lit("x"))).alias("rows"))

    k = F.col("o_orderkey") % 4
    whole, part, longer, none = ("Pos.", "Bezeichnung", "Menge", "Betrag"), ("Pos", "Bezeichnung", "Menge", "Netto"), ("Position", "Art-Bezeichnung", "Menge (Stk)", "Gesamtbetrag"), ("Datum", "Menge", "Name", "Ort")
    tables_ = F.when(k == 0, F.array(table(1, *whole), table(2, *whole))).when(k == 1, F.array(table(1, *none), table(2, *part))).when(k == 2, F.array(table(1, *part), table(2, *longer))).otherwise(F.array(table(1, *none), table(2, *none)))
    signature = F.array(*map(F.lit, ("Pos", "Bezeichnung", "Menge", "Betrag")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), T.match_table(tables_.cast(f"array<{TABLE}>"), signature)["page"].alias("page"))


@query(f"""WITH r AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) * 100 AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS t, CAST(round(l_extendedprice * 100) AS BIGINT) // 10 AS p,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS n FROM lineitem)
SELECT k, CAST(count(*) AS INTEGER) AS description, CAST(count_if(true) AS INTEGER) AS quantity, CAST(count_if(p = q) AS INTEGER) AS quantity_in_price, CAST(count(*) AS INTEGER) AS line_total, CAST(count_if(t = p) AS INTEGER) AS price_in_total FROM r GROUP BY k""")
def column_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of words, quantity, price (a tenth of the total, cut) and total; votes for each column by the known items."""
    li = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "l_orderkey")
    keyed = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    whole = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(keyed)).alias("xs"))

    def values(x: Column, i: Column) -> Column:
        cents = F.round(x["l_extendedprice"] * 100).cast("long")
        def money(c: Column) -> Column:
            return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))

        return F.struct(
            F.lit(None).cast("int").alias("position"), F.concat(F.lit("Ware "), F.lpad(i.cast("string"), 6, "0")).alias("description"), x["l_quantity"].cast("int").cast("string").alias("quantity"),
            F.lit(None).cast("string").alias("unit"), money(F.floor(cents / 10)).alias("unit_price"), F.lit(None).cast("double").alias("tax_rate"), money(cents).alias("line_total"),
        )

    whole = whole.withColumn("items", F.transform("xs", values))
    rows = F.transform("items", lambda x: F.array(x["description"], x["quantity"], F.replace(x["unit_price"], F.lit("."), F.lit(",")), F.replace(x["line_total"], F.lit("."), F.lit(","))))
    table = F.struct(F.array(*map(F.lit, ("a", "b", "c", "d"))).alias("header"), rows.alias("rows"))
    voted = whole.withColumn("table", table).withColumn("votes", T.column_votes(F.col("items"), F.col("table"), F.lit(",")))

    def count(key: str, column: int) -> Column:
        return F.size(F.filter("votes", lambda v: (v["key"] == F.lit(key)) & (v["column"] == column)))

    return voted.select("k", count("description", 0).alias("description"), count("quantity", 1).alias("quantity"), count("quantity", 2).alias("quantity_in_price"), count("line_total", 3).alias("line_total"), count("unit_price", 3).alias("price_in_total"))
