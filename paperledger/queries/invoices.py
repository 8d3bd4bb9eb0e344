"""Orders as invoices: constraints, repairs and verdicts.

A line's total is its extended price, its unit price the total by the quantity to four places, and its VAT rate comes
from the table's tax, mapped onto 0, 7 and 19 (or left as it is, outside the closed set). Net, tax and gross are sums.
Some orders' gross (keys divisible by 11) is 1.00 too high, and some lines' unit price (parts divisible by 13) too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators import reconcile as R
from ..plans.options import Reconcile
from ..plans.schemas import AMOUNT, RATE, REPAIR, WORK_LINE, WORK_VAT
from . import query, read, spread

LINES_SQL = """
WITH l0 AS (SELECT l_orderkey AS k, l_partkey AS part, l_linenumber AS n, CAST(round(l_extendedprice * 100) AS BIGINT) AS t,
 CAST(l_quantity AS BIGINT) AS q, CAST(round(l_tax * 100) AS BIGINT) AS r0 FROM lineitem),
l AS (SELECT *, CASE r0 % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 19 END AS rate,
 (2 * t * 100 + q) // (2 * q) + CASE WHEN part % 13 = 0 THEN 10000 ELSE 0 END AS p FROM l0),
v AS (SELECT k, rate, sum(t) AS net, (2 * sum(t) * rate + 100) // 200 AS tax, count(*) AS lines FROM l GROUP BY k, rate),
h AS (SELECT k, CAST(sum(net) AS BIGINT) AS net, CAST(sum(tax) AS BIGINT) AS tax, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS rates,
 CAST(sum(net) + sum(tax) + CASE WHEN k % 11 = 0 THEN 100 ELSE 0 END AS BIGINT) AS gross FROM v GROUP BY k)
"""


def cents(c: Column) -> Column:
    return F.round(c * 100, 0).cast("bigint")


def working(spark: SparkSession, sf_dir: str, mapped: bool = True) -> DataFrame:
    """``k`` and the working columns of each order. Lines meet once, by order, and are summed by rate within its row."""
    li = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"), "l_orderkey")
    hundredths = F.round(F.col("l_tax") * 100).cast("int")
    rate = F.when(hundredths % 3 == 0, 0).when(hundredths % 3 == 1, 7).otherwise(19) if mapped else hundredths
    t, q = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast(AMOUNT)
    price = F.round(F.try_divide(t, q), 4) + F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0)
    line = F.struct(
        F.col("l_linenumber").cast("int").alias("position"),
        F.concat(F.lit("part "), F.col("l_partkey")).alias("description"),
        q.alias("quantity"),
        F.lit("pc").alias("unit"),
        price.cast(AMOUNT).alias("unit_price"),
        rate.cast(RATE).alias("tax_rate"),
        t.cast(AMOUNT).alias("line_total"),
    )
    rows = li.select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", line.cast(WORK_LINE).alias("line")).alias("x"))
    whole = rows.groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    whole = whole.select("k", F.transform("xs", lambda x: x["line"]).alias("lines"))
    rates = F.sort_array(F.array_distinct(F.transform("lines", lambda x: x["tax_rate"])), asc=False)

    def entry(r: Column) -> Column:
        own = F.transform(F.filter("lines", lambda x: x["tax_rate"].eqNullSafe(r)), lambda x: x["line_total"])
        net = let(own, lambda own: F.when(F.exists(own, lambda t: t.isNotNull()), R._sum(own, lambda t: t)).cast(AMOUNT))
        return let(net, lambda net: F.struct(r.alias("rate"), net.alias("net"), F.round(net * r * F.lit("0.01").cast("decimal(3,2)"), 2).cast(AMOUNT).alias("tax")))

    whole = whole.withColumn("vat", let(rates, lambda rates: F.transform(rates, entry)).cast(f"array<{WORK_VAT}>"))
    orders = spread(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    whole = orders.join(whole, "k", "left")
    vat, lines = F.coalesce("vat", F.array().cast(f"array<{WORK_VAT}>")), F.coalesce("lines", F.array().cast(f"array<{WORK_LINE}>"))
    whole = whole.select("k", vat.alias("vat"), lines.alias("lines"))
    some = F.size("lines") > 0
    whole = whole.withColumn("net", F.when(some, R._sum(F.col("vat"), lambda v: v["net"]).cast(AMOUNT))).withColumn("tax", F.when(some, R._sum(F.col("vat"), lambda v: v["tax"]).cast(AMOUNT)))
    gross = (F.col("net") + F.col("tax") + F.when(F.col("k") % 11 == 0, 1).otherwise(0)).cast(AMOUNT)
    return whole.withColumns({"gross": gross, "repairs": F.array().cast(f"array<{REPAIR}>")})


def _check(df: DataFrame, name: str, *more: Column) -> DataFrame:
    c = R.checks()[name]
    return df.select("k", c["evaluable"].alias("evaluable"), c["holds"].alias("holds"), F.size(c["violations"]).alias("n_violations"), *more)


ALL = "SELECT o_orderkey AS k FROM orders"


@query(LINES_SQL + f"""SELECT o.k, h.k IS NOT NULL AS evaluable, coalesce(abs(h.net + h.tax - h.gross) <= 2, false) AS holds,
 CAST(CASE WHEN abs(h.net + h.tax - h.gross) > 2 THEN 1 ELSE 0 END AS INTEGER) AS n_violations, h.net + h.tax - h.gross AS delta
 FROM ({ALL}) o LEFT JOIN h USING (k)""")
def c1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(working(spark, sf_dir), "C1_TOTALS", cents(F.col("net") + F.col("tax") - F.col("gross")).alias("delta"))


@query(LINES_SQL + f""", m AS (SELECT *, net + CASE WHEN k % 5 = 0 THEN tax ELSE 0 END AS claimed FROM h)
SELECT o.k, m.k IS NOT NULL AS evaluable, coalesce(2 * abs(m.net - m.claimed) <= 4 + m.lines, false) AS holds,
 CAST(CASE WHEN 2 * abs(m.net - m.claimed) > 4 + m.lines THEN 1 ELSE 0 END AS INTEGER) AS n_violations,
 CASE WHEN 2 * abs(m.net - m.claimed) > 4 + m.lines AND 2 * abs(m.net - m.tax) <= 4 + m.lines THEN 'lines_may_be_gross' END AS hint
 FROM ({ALL}) o LEFT JOIN m USING (k)""")
def c2_line_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order claims net plus tax as its net; its gross is set to the tax for the hint's sake."""
    df = working(spark, sf_dir)
    df = df.withColumns({"net": (F.col("net") + F.when(F.col("k") % 5 == 0, F.col("tax")).otherwise(0)).cast(AMOUNT), "gross": F.col("tax")})
    hint = F.get(R.checks()["C2_LINE_SUM"]["violations"], F.lit(0))["hint"]
    return _check(df, "C2_LINE_SUM", hint.alias("hint"))


@query(LINES_SQL + f""", c AS (SELECT k, count_if(abs(q * p - t * 100) > 100) AS bad FROM l GROUP BY k)
SELECT o.k, c.k IS NOT NULL AS evaluable, coalesce(c.bad = 0, false) AS holds, CAST(coalesce(c.bad, 0) AS INTEGER) AS n_violations FROM ({ALL}) o LEFT JOIN c USING (k)""")
def c3_line_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(working(spark, sf_dir), "C3_LINE_MATH")


@query(LINES_SQL + f""", c AS (SELECT h.k, (SELECT count_if(abs(v.net * v.rate - (v.tax + CASE WHEN v.k % 7 = 0 AND v.rate = 19 THEN 5 ELSE 0 END) * 100) > 200) FROM v WHERE v.k = h.k)
 + CASE WHEN h.k % 7 = 0 AND EXISTS (SELECT 1 FROM v WHERE v.k = h.k AND v.rate = 19) THEN 1 ELSE 0 END AS bad FROM h)
SELECT o.k, c.k IS NOT NULL AS evaluable, coalesce(c.bad = 0, false) AS holds, CAST(coalesce(c.bad, 0) AS INTEGER) AS n_violations FROM ({ALL}) o LEFT JOIN c USING (k)""")
def c4_vat_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order's tax at 19 % is 0.05 too high: its entry and its sum of taxes fail."""
    df = working(spark, sf_dir)
    wrong = F.transform("vat", lambda v: R._entry(v, tax=(v["tax"] + F.when((F.col("k") % 7 == 0) & (v["rate"] == 19), F.lit("0.05").cast("decimal(3,2)")).otherwise(0)).cast(AMOUNT)))
    return _check(df.withColumn("vat", wrong), "C4_VAT_SUM")


@query(f"""WITH r AS (SELECT l_orderkey AS k, CAST(round(l_tax * 100) AS BIGINT) AS rate FROM lineitem),
c AS (SELECT k, count_if(rate NOT IN (0, 7, 19)) + count(DISTINCT CASE WHEN rate NOT IN (0, 7, 19) THEN rate END) AS bad FROM r GROUP BY k)
SELECT o.k, c.k IS NOT NULL AS evaluable, coalesce(c.bad = 0, false) AS holds, CAST(coalesce(c.bad, 0) AS INTEGER) AS n_violations FROM ({ALL}) o LEFT JOIN c USING (k)""")
def c5_closed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(working(spark, sf_dir, mapped=False), "C5_VAT_CLOSED_SET")


VERDICT_SQL = LINES_SQL + f""", c3 AS (SELECT k, count_if(abs(q * p - t * 100) > 100) AS bad FROM l GROUP BY k),
x AS (SELECT o.k, h.k IS NULL AS empty, coalesce(h.gross <> h.net + h.tax, false) AS c1, coalesce(c3.bad, 0) AS c3 FROM ({ALL}) o LEFT JOIN h USING (k) LEFT JOIN c3 USING (k))
"""


@query(VERDICT_SQL + """SELECT k, CASE WHEN empty OR c1 OR c3 > 0 THEN 'failed' ELSE 'reconciled' END AS status, false AS total_failure,
 CASE WHEN empty THEN 'LINE_ITEMS_MISSING,TOTALS_INCOMPLETE,VAT_MISSING' ELSE concat_ws(',', CASE WHEN c1 THEN 'C1_TOTALS' END, CASE WHEN c3 > 0 THEN 'C3_LINE_MATH' END) END AS failed,
 CAST(CASE WHEN empty THEN 3 ELSE CAST(c1 AS INTEGER) + c3 END AS INTEGER) AS n_violations FROM x""")
def reconcile_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = R.verdict(working(spark, sf_dir))
    names = F.array_sort(F.array_distinct(F.transform("violations", lambda v: v["constraint"])))
    return done.select("k", "status", "total_failure", F.array_join(names, ",").alias("failed"), F.size("violations").alias("n_violations"))


@query(LINES_SQL + f""", x AS (SELECT k, net, tax, rates, lines FROM h)
SELECT o.k, coalesce(abs(x.tax) > 2 AND 2 * abs(x.net) > 4 + x.lines, false) AS total_failure FROM ({ALL}) o LEFT JOIN x USING (k)""")
def total_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose header says net 0 and gross as it is, whose lines have totals alone, and that have no VAT rows:
    C1 and C2 can be evaluated, and none holds."""
    df = working(spark, sf_dir)
    bare = F.transform("lines", lambda x: R._line(x, quantity=F.lit(None).cast(AMOUNT), unit_price=F.lit(None).cast(AMOUNT), tax_rate=F.lit(None).cast(RATE)))
    some = F.size("lines") > 0
    net = F.when(some, (F.col("net") * 2).cast(AMOUNT))
    df = df.withColumns({"gross": F.when(some, net), "net": net, "lines": bare, "vat": F.array().cast(f"array<{WORK_VAT}>")})
    return R.verdict(df).select("k", "total_failure")


def _repaired(df: DataFrame, *columns: Column, rules=R.RULES, passes: int = 5) -> DataFrame:
    done = R.repair(df, Reconcile(passes=passes), rules)
    names = F.array_join(F.transform("repairs", lambda r: F.concat_ws(" ", r["rule"], r["path"])), ",")
    return done.select("k", *columns, names.alias("repairs"))


def _erased(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.withColumns({n: F.when(~c, F.col(n)) for n, c in conditions.items()})


@query(LINES_SQL + f"""SELECT o.k, h.net, h.tax, CASE WHEN h.k IS NULL THEN '' ELSE 'R_TOTALS_FROM_VAT totals.net,R_TOTALS_FROM_VAT totals.tax' END AS repairs FROM ({ALL}) o LEFT JOIN h USING (k)""")
def repair_totals_from_vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _erased(working(spark, sf_dir), net=F.lit(True), tax=F.lit(True), gross=F.lit(True))
    return _repaired(df, cents(F.col("net")).alias("net"), cents(F.col("tax")).alias("tax"), rules=R.RULES[:1], passes=1)


@query(LINES_SQL + f"""SELECT o.k, h.net, CASE WHEN h.k IS NULL OR o.k % 2 = 1 THEN '' ELSE 'R_NET_FROM_LINES totals.net' END AS repairs FROM ({ALL}) o LEFT JOIN h USING (k)""")
def repair_net_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _erased(working(spark, sf_dir), net=F.col("k") % 2 == 0)
    return _repaired(df, cents(F.col("net")).alias("net"), rules=(R.net_from_lines,), passes=1)


@query(LINES_SQL + f"""SELECT o.k, CASE WHEN o.k % 4 = 0 THEN h.gross - h.tax ELSE h.net END AS net, CASE WHEN o.k % 4 = 1 THEN h.gross - h.net ELSE h.tax END AS tax,
 CASE WHEN o.k % 4 = 2 THEN h.net + h.tax ELSE h.gross END AS gross,
 CASE WHEN h.k IS NULL THEN '' ELSE coalesce('R_TOTAL_DERIVE totals.' || CASE o.k % 4 WHEN 0 THEN 'net' WHEN 1 THEN 'tax' WHEN 2 THEN 'gross' END, '') END AS repairs FROM ({ALL}) o LEFT JOIN h USING (k)""")
def repair_total_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 4
    df = _erased(working(spark, sf_dir), net=k == 0, tax=k == 1, gross=k == 2)
    return _repaired(df, *[cents(F.col(n)).alias(n) for n in ("net", "tax", "gross")], rules=(R.total_derive,), passes=1)


@query(LINES_SQL + f""", f AS (SELECT k, list_filter([19, 7, 0], lambda r: abs(net * r - tax * 100) <= 200) AS fits FROM h)
SELECT o.k, CAST(CASE WHEN len(f.fits) = 1 THEN f.fits[1] END AS INTEGER) AS rate, CASE WHEN len(f.fits) = 1 THEN 'R_VAT_SYNTH vatBreakdown.0' ELSE '' END AS repairs FROM ({ALL}) o LEFT JOIN f USING (k)""")
def repair_vat_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = working(spark, sf_dir).withColumn("vat", F.array().cast(f"array<{WORK_VAT}>"))
    return _repaired(df, F.get("vat", F.lit(0))["rate"].cast("int").alias("rate"), rules=(R.vat_synth,), passes=1)


@query(LINES_SQL + f""", top AS (SELECT k, max(rate) AS rate FROM v GROUP BY k)
SELECT o.k, CAST(v.net AS BIGINT) AS net, CASE WHEN v.k IS NULL THEN '' ELSE 'R_VAT_SYNTH vatBreakdown.0.net' END AS repairs FROM ({ALL}) o LEFT JOIN top USING (k) LEFT JOIN v ON v.k = top.k AND v.rate = top.rate""")
def repair_vat_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry's net is gone; the header's net less the others' gives it back."""
    df = working(spark, sf_dir).withColumn("vat", F.transform("vat", lambda v, i: F.when(i == 0, R._entry(v, net=F.lit(None).cast(AMOUNT))).otherwise(v)))
    return _repaired(df, cents(F.get("vat", F.lit(0))["net"]).alias("net"), rules=(R.vat_synth,), passes=1)


@query(LINES_SQL + f""", a AS (SELECT k, CAST(sum(CASE WHEN k % 2 = 0 THEN tax WHEN rate = 0 THEN 0 ELSE (2 * tax * 100 + rate) // (2 * rate) END) AS BIGINT) AS total,
 count(CASE WHEN k % 2 = 0 OR rate > 0 THEN 1 END) AS n_repairs FROM v GROUP BY k)
SELECT o.k, coalesce(a.total, 0) AS total, CAST(coalesce(a.n_repairs, 0) AS INTEGER) AS n_repairs FROM ({ALL}) o LEFT JOIN a USING (k)""")
def repair_vat_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a header: even orders lack all taxes, odd ones all nets; each comes from the other and the rate."""
    even, none = F.col("k") % 2 == 0, F.lit(None).cast(AMOUNT)
    df = _erased(working(spark, sf_dir), net=F.lit(True), tax=F.lit(True), gross=F.lit(True))
    df = df.withColumn("vat", F.transform("vat", lambda v: F.when(even, R._entry(v, tax=none)).otherwise(R._entry(v, net=none))))
    done = R.repair(df, Reconcile(passes=1), (R.vat_synth,))
    total = F.when(even, R._sum(F.col("vat"), lambda v: v["tax"])).otherwise(R._sum(F.col("vat"), lambda v: v["net"]))
    return done.select("k", cents(total).alias("total"), F.size("repairs").alias("n_repairs"))


def _lines_without(df: DataFrame, **conditions) -> DataFrame:
    def erased(x: Column, i: Column) -> Column:
        return R._line(x, **{n: F.when(~c(x, i), x[n]) for n, c in conditions.items()})

    return df.withColumn("lines", F.transform("lines", erased))


def _line_result(df: DataFrame, field: str, scale: int, rule) -> DataFrame:
    done = R.repair(df, Reconcile(passes=1), (rule,))
    total = R._sum(F.col("lines"), lambda x: x[field])
    rules = F.array_join(F.array_sort(F.array_distinct(F.transform("repairs", lambda r: r["rule"]))), ",")
    return done.select("k", F.round(total * scale, 0).cast("bigint").alias("total"), F.size("repairs").alias("n_repairs"), rules.alias("rules"))


@query(LINES_SQL + f""", a AS (SELECT k, CAST(sum((2 * q * p + 100) // 200) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS n FROM l GROUP BY k)
SELECT o.k, coalesce(a.total, 0) AS total, coalesce(a.n, 0) AS n_repairs, CASE WHEN a.k IS NULL THEN '' ELSE 'R_LINETOTAL_DERIVE' END AS rules FROM ({ALL}) o LEFT JOIN a USING (k)""")
def repair_line_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_result(_lines_without(working(spark, sf_dir), line_total=lambda x, i: F.lit(True)), "line_total", 100, R.line_total_derive)


@query(LINES_SQL + f""", a AS (SELECT k, CAST(sum((2 * t * 100 + q) // (2 * q)) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS n FROM l GROUP BY k)
SELECT o.k, coalesce(a.total, 0) AS total, coalesce(a.n, 0) AS n_repairs, CASE WHEN a.k IS NULL THEN '' ELSE 'R_UNITPRICE_DERIVE' END AS rules FROM ({ALL}) o LEFT JOIN a USING (k)""")
def repair_unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_result(_lines_without(working(spark, sf_dir), unit_price=lambda x, i: F.lit(True)), "unit_price", 10_000, R.unit_price_derive)


@query(LINES_SQL + f""", d AS (SELECT *, (2 * t * 100 * 10000 + p) // (2 * p) AS q2 FROM l WHERE part % 13 <> 0 OR part % 3 = 0),
e AS (SELECT k, CASE WHEN part % 3 = 0 THEN 10000 WHEN abs(q2 * p - t * 1000000) <= 1000000 THEN q2 END AS got FROM d UNION ALL
 SELECT k, CASE WHEN abs(((2 * t * 1000000 + p) // (2 * p)) * p - t * 1000000) <= 1000000 THEN (2 * t * 1000000 + p) // (2 * p) END FROM l WHERE part % 13 = 0 AND part % 3 <> 0),
a AS (SELECT k, CAST(coalesce(sum(got), 0) AS BIGINT) AS total, CAST(count(got) AS INTEGER) AS n, concat_ws(',', max(CASE WHEN got = 10000 THEN 'R_QTY_DEFAULT' END), max(CASE WHEN got <> 10000 THEN 'R_QTY_DERIVE' END)) AS rules FROM e GROUP BY k)
SELECT o.k, coalesce(a.total, 0) AS total, coalesce(a.n, 0) AS n_repairs, coalesce(a.rules, '') AS rules FROM ({ALL}) o LEFT JOIN a USING (k)""")
def repair_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No line has a quantity; lines of parts divisible by 3 lack the unit price too."""
    third = lambda x, i: F.substring(x["description"], 6, 20).cast("bigint") % 3 == 0
    return _line_result(_lines_without(working(spark, sf_dir), quantity=lambda x, i: F.lit(True), unit_price=third), "quantity", 10_000, R.quantity_repair)


@query(LINES_SQL + f""", a AS (SELECT h.k, h.rates = 1 AND h.tax IS NOT NULL AND 2 * abs((2 * h.net * v.rate + 100) // 200 - h.tax) <= 4 + h.lines AS good, h.lines, v.rate FROM h JOIN v ON v.k = h.k AND h.rates = 1)
SELECT o.k, CAST(coalesce(CASE WHEN a.good THEN a.lines * a.rate ELSE 0 END, 0) AS BIGINT) AS total, CAST(coalesce(CASE WHEN a.good THEN a.lines ELSE 0 END, 0) AS INTEGER) AS n_repairs,
 CASE WHEN a.good THEN 'R_LINE_TAX_INHERIT' ELSE '' END AS rules FROM ({ALL}) o LEFT JOIN a USING (k)""")
def repair_line_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_result(_lines_without(working(spark, sf_dir), tax_rate=lambda x, i: F.lit(True)), "tax_rate", 1, R.line_tax_inherit)


@query(LINES_SQL + f"""SELECT o.k, h.net, h.tax, h.net + h.tax AS gross, CAST(coalesce(h.net, 0) AS BIGINT) AS lines_total, h.k IS NOT NULL AS reconciled FROM ({ALL}) o LEFT JOIN h USING (k)""")
def repair_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erasures by the key's remainders that all rules together undo: totals of lines or unit prices, net or tax, gross."""
    df = working(spark, sf_dir)
    df = df.withColumns({"lines": F.transform("lines", lambda x: R._line(x, unit_price=F.round(F.try_divide(x["line_total"], x["quantity"]), 4).cast(AMOUNT)))})
    k = F.col("k")
    df = _lines_without(df, line_total=lambda x, i: k % 2 == 0, unit_price=lambda x, i: (k % 2 == 1) & (k % 5 == 0))
    df = df.withColumn("vat", F.when(k % 3 == 0, F.transform("vat", lambda v: R._entry(v, tax=F.lit(None).cast(AMOUNT)))).otherwise(F.col("vat")))
    df = _erased(df, net=k % 4 == 0, tax=k % 7 == 0, gross=F.lit(True))
    done = R.verdict(df)
    return done.select("k", *[cents(F.col(n)).alias(n) for n in ("net", "tax", "gross")], cents(R._sum(F.col("lines"), lambda x: x["line_total"])).alias("lines_total"), (F.col("status") == "reconciled").alias("reconciled"))


@query(LINES_SQL + "SELECT k, CAST(rate AS INTEGER) AS rate, CAST(net AS BIGINT) AS net, CAST(tax AS BIGINT) AS tax FROM v")
def vat_breakdown_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = working(spark, sf_dir).select("k", F.explode(R.by_rate(F.col("lines"))).alias("v"))
    return v.select("k", F.col("v.rate").cast("int").alias("rate"), cents(F.col("v.net")).alias("net"), cents(F.col("v.tax")).alias("tax"))


@query("""SELECT l_orderkey AS k, CAST(count(DISTINCT CAST(round(l_tax * 100) AS INTEGER)) AS INTEGER) AS n, string_agg(DISTINCT CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR), ',' ORDER BY CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR)) AS rates FROM lineitem GROUP BY 1""")
def distinct_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.collect_set(F.round(F.col("l_tax") * 100).cast("int").cast("string"))
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(rates.alias("r"))
    return li.select("k", F.size("r").alias("n"), F.array_join(F.array_sort("r"), ",").alias("rates"))
