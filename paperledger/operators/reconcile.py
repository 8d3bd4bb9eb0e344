"""Reconciliation: constraints, repairs to a fix-point, and the verdict. Decimals throughout, never doubles.

The working row holds ``net``, ``tax``, ``gross`` as DECIMAL(18,4), ``vat`` and ``lines`` as arrays of structs with such
amounts, and ``repairs``. A missing number is null, never zero. Rules fill nulls and never overwrite; a pass that fires
nothing leaves the row as it is, so running all passes equals stopping at the first idle one. Every step is a
projection of the row: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import money, quantity, to_decimal
from ..functions.text import clean
from ..plans.options import Reconcile
from ..plans.schemas import AMOUNT, CANONICAL, RATE, REPAIR, VIOLATION, WORK_LINE, WORK_VAT, canonical_issues

SUM = "decimal(38,4)"
DEFAULT = Reconcile()


def load(df: DataFrame, invoice: str = "invoice") -> DataFrame:
    """``df`` with the working columns of its candidate invoice."""
    c = F.col(invoice)
    vat = F.transform(F.coalesce(c["vat_breakdown"], F.array().cast("array<struct<rate:double,net:string,tax:string>>")), lambda v: F.struct(v["rate"].cast(RATE).alias("rate"), to_decimal(v["net"]).alias("net"), to_decimal(v["tax"]).alias("tax")))
    lines = F.transform(
        c["line_items"],
        lambda x: F.struct(
            x["position"].alias("position"),
            x["description"].alias("description"),
            to_decimal(x["quantity"]).alias("quantity"),
            clean(x["unit"]).alias("unit"),
            to_decimal(x["unit_price"]).alias("unit_price"),
            x["tax_rate"].cast(RATE).alias("tax_rate"),
            to_decimal(x["line_total"]).alias("line_total"),
        ),
    )
    return df.withColumns(
        {
            "net": to_decimal(c["totals"]["net"]),
            "tax": to_decimal(c["totals"]["tax"]),
            "gross": to_decimal(c["totals"]["gross"]),
            "vat": vat.cast(f"array<{WORK_VAT}>"),
            "lines": F.coalesce(lines, F.array().cast(f"array<{WORK_LINE}>")).cast(f"array<{WORK_LINE}>"),
            "repairs": F.array().cast(f"array<{REPAIR}>"),
        }
    )


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0).cast(SUM), lambda a, x: (a + F.coalesce(value(x), F.lit(0))).cast(SUM))


def _violation(constraint: str, paths: Column, detail: Column, delta: Column | None = None, hint: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(constraint).alias("constraint"),
        paths.alias("paths"),
        detail.alias("detail"),
        (none if delta is None else F.round(delta, 2).cast("decimal(38,2)").cast("string")).alias("delta"),
        (none if hint is None else hint).alias("hint"),
    ).cast(VIOLATION)


def _paths(*paths) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in paths])


def _plain(value: Column) -> Column:
    return F.coalesce(quantity(value), F.lit("null"))


def _some(condition: Column, violation: Column) -> Column:
    return F.when(condition, F.array(violation)).otherwise(F.array().cast(f"array<{VIOLATION}>"))


def checks(options: Reconcile = DEFAULT) -> dict[str, dict[str, Column]]:
    """For each constraint over the working columns: evaluable, holds (false where not evaluable) and violations."""
    net, tax, gross, vat, lines = map(F.col, ("net", "tax", "gross", "vat", "lines"))
    header, line, slack = (F.lit(x).cast("decimal(9,4)") for x in (options.tolerance_header, options.tolerance_line, options.slack_per_line))
    out = {}

    def add(name: str, evaluable: Column, violations: Column) -> None:
        evaluable = F.coalesce(evaluable, F.lit(False))
        violations = F.when(evaluable, violations).otherwise(F.array().cast(f"array<{VIOLATION}>"))
        out[name] = {"evaluable": evaluable, "holds": evaluable & (F.size(violations) == 0), "violations": violations}

    delta = net + tax - gross
    detail = F.concat(F.lit("net ("), _plain(net), F.lit(") + tax ("), _plain(tax), F.lit(") != gross ("), _plain(gross), F.lit(")"))
    add("C1_TOTALS", net.isNotNull() & tax.isNotNull() & gross.isNotNull(), _some(F.abs(delta) > header, _violation("C1_TOTALS", _paths("totals.net", "totals.tax", "totals.gross"), detail, delta)))

    total = _sum(lines, lambda x: x["line_total"])
    tolerance = header + slack * F.size(lines)
    delta2 = total - net
    hint = F.when(F.abs(total - gross) <= tolerance, F.lit("lines_may_be_gross"))
    detail2 = F.concat(F.lit("sum of line totals ("), money(total), F.lit(") != totals.net ("), _plain(net), F.lit(")"))
    add("C2_LINE_SUM", net.isNotNull() & (F.size(lines) > 0) & F.forall(lines, lambda x: x["line_total"].isNotNull()), _some(F.abs(delta2) > tolerance, _violation("C2_LINE_SUM", _paths("lineItems", "totals.net"), detail2, delta2, hint)))

    def whole(x: Column) -> Column:
        return x["quantity"].isNotNull() & x["unit_price"].isNotNull() & x["line_total"].isNotNull()

    def line_delta(x: Column) -> Column:
        return x["quantity"] * x["unit_price"] - x["line_total"]

    def line_violation(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("lineItems."), i.cast("string"))
        detail3 = F.concat(F.lit("line "), i.cast("string"), F.lit(": "), _plain(x["quantity"]), F.lit(" × "), _plain(x["unit_price"]), F.lit(" != "), _plain(x["line_total"]))
        found = _violation("C3_LINE_MATH", _paths(F.concat(at, F.lit(".quantity")), F.concat(at, F.lit(".unitPrice")), F.concat(at, F.lit(".lineTotal"))), detail3, line_delta(x))
        return F.when(whole(x) & (F.abs(line_delta(x)) > line), found)

    add("C3_LINE_MATH", F.exists(lines, whole), F.filter(F.transform(lines, line_violation), lambda v: v.isNotNull()))

    # Times 100 on both sides instead of a division: exact.
    def vat_delta(v: Column) -> Column:
        return v["net"] * v["rate"] - v["tax"] * 100

    def vat_violation(v: Column, i: Column) -> Column:
        n = i.cast("string")
        detail4 = F.concat(F.lit("VAT entry "), n, F.lit(": "), _plain(v["net"]), F.lit(" × "), _plain(v["rate"]), F.lit("% != "), _plain(v["tax"]))
        return F.when(F.abs(vat_delta(v)) > header * 100, _violation("C4_VAT_SUM", _paths(F.concat(F.lit("vatBreakdown."), n)), detail4, vat_delta(v) * F.lit("0.01").cast("decimal(3,2)")))

    complete = F.forall(vat, lambda v: v["rate"].isNotNull() & v["net"].isNotNull() & v["tax"].isNotNull())
    sums = []
    for name, plural, column in (("net", "nets", net), ("tax", "taxes", tax)):
        whole_sum = _sum(vat, lambda v: v[name])  # noqa: B023
        words = F.concat(F.lit(f"sum of VAT {plural} ("), money(whole_sum), F.lit(f") != totals.{name} ("), _plain(column), F.lit(")"))
        sums.append(_some(F.coalesce(F.abs(whole_sum - column) > header, F.lit(False)), _violation("C4_VAT_SUM", _paths("vatBreakdown", f"totals.{name}"), words, whole_sum - column)))
    add("C4_VAT_SUM", (F.size(vat) > 0) & complete, F.concat(F.filter(F.transform(vat, vat_violation), lambda v: v.isNotNull()), *sums))

    rates = F.array(*[F.lit(r).cast(RATE) for r in options.vat_rates])

    def bad_rate(kind: str, field: str, name: str):
        def one(x: Column, i: Column) -> Column:
            words = F.concat(F.lit("VAT rate "), _plain(x[field]), F.lit(f"% not in the configured set [{', '.join(options.vat_rates)}]"))
            found = _violation("C5_VAT_CLOSED_SET", _paths(F.concat(F.lit(f"{kind}."), i.cast("string"), F.lit(f".{name}"))), words)
            return F.when(x[field].isNotNull() & ~F.array_contains(rates, x[field]), found)

        return one

    outside = F.concat(F.transform(vat, bad_rate("vatBreakdown", "rate", "rate")), F.transform(lines, bad_rate("lineItems", "tax_rate", "taxRate")))
    add("C5_VAT_CLOSED_SET", F.exists(vat, lambda v: v["rate"].isNotNull()) | F.exists(lines, lambda x: x["tax_rate"].isNotNull()), F.filter(outside, lambda v: v.isNotNull()))
    return out


def _repair(rule: str, path: Column | str, to: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), (F.lit(path) if isinstance(path, str) else path).alias("path"), to.alias("to"))


def _log(*found: tuple[Column, Column]) -> Column:
    """The repairs with those of ``found`` (whether there is one, and it) that there are."""
    some = found[0][0]
    for made, _ in found[1:]:
        some = some | made
    told = F.filter(F.array(*[F.when(made, r) for made, r in found]), lambda r: r.isNotNull())
    return F.when(some, F.concat(F.col("repairs"), told)).otherwise(F.col("repairs"))


def _log_each(items: Column, one) -> Column:
    return F.concat(F.col("repairs"), F.filter(F.transform(items, one), lambda r: r.isNotNull()))


def _where(gaps: Column, work: Column, name: str) -> Column:
    """``work`` for rows with gaps; the column as it is for all others, so that an idle pass costs a look at nulls."""
    return F.when(gaps, work).otherwise(F.col(name))


def _line(x: Column, **changed: Column) -> Column:
    names = ("position", "description", "quantity", "unit", "unit_price", "tax_rate", "line_total")
    return F.struct(*[changed.get(n, x[n]).alias(n) for n in names])


def _entry(v: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(n, v[n]).alias(n) for n in ("rate", "net", "tax")])


def _path(kind: str, i: Column, name: str) -> Column:
    return F.concat(F.lit(f"{kind}."), i.cast("string"), F.lit(f".{name}"))


def totals_from_vat(df: DataFrame, o: Reconcile) -> DataFrame:
    vat = F.col("vat")
    ready = (F.size(vat) > 0) & F.forall(vat, lambda v: v["net"].isNotNull() & v["tax"].isNotNull())
    new = {n: F.when(F.col(n).isNull() & ready, F.round(_sum(vat, lambda v: v[n]), 2).cast(AMOUNT)) for n in ("net", "tax")}  # noqa: B023
    df = df.withColumns({f"_{n}": c for n, c in new.items()})
    log = [(F.col(f"_{n}").isNotNull(), _repair("R_TOTALS_FROM_VAT", f"totals.{n}", money(f"_{n}"))) for n in new]
    return df.withColumns({**{n: F.coalesce(n, f"_{n}") for n in new}, "repairs": _log(*log)}).drop(*[f"_{n}" for n in new])


def net_from_lines(df: DataFrame, o: Reconcile) -> DataFrame:
    lines = F.col("lines")
    ready = F.col("net").isNull() & (F.size(lines) > 0) & F.forall(lines, lambda x: x["line_total"].isNotNull())
    df = df.withColumn("_net", F.when(ready, F.round(_sum(lines, lambda x: x["line_total"]), 2).cast(AMOUNT)))
    return df.withColumns({"net": F.coalesce("net", "_net"), "repairs": _log((F.col("_net").isNotNull(), _repair("R_NET_FROM_LINES", "totals.net", money("_net"))))}).drop("_net")


def total_derive(df: DataFrame, o: Reconcile) -> DataFrame:
    net, tax, gross = map(F.col, ("net", "tax", "gross"))
    df = df.withColumns({"_net": F.when(net.isNull(), gross - tax).cast(AMOUNT), "_tax": F.when(tax.isNull(), gross - net).cast(AMOUNT), "_gross": F.when(gross.isNull(), net + tax).cast(AMOUNT)})
    log = [(F.col(f"_{n}").isNotNull(), _repair("R_TOTAL_DERIVE", f"totals.{n}", money(f"_{n}"))) for n in ("net", "tax", "gross")]
    return df.withColumns({**{n: F.coalesce(n, f"_{n}") for n in ("net", "tax", "gross")}, "repairs": _log(*log)}).drop("_net", "_tax", "_gross")


def vat_synth(df: DataFrame, o: Reconcile) -> DataFrame:
    header = F.lit(o.tolerance_header).cast("decimal(9,4)")
    net, tax, vat = map(F.col, ("net", "tax", "vat"))
    rates = F.array(*[F.lit(r).cast(RATE) for r in o.vat_rates])
    fits = F.filter(rates, lambda r: F.abs(net * r - tax * 100) <= header * 100)
    df = df.withColumn("_rate", F.when((F.size(vat) == 0) & net.isNotNull() & tax.isNotNull() & (F.size(fits) == 1), F.get(fits, F.lit(0))))
    made = F.struct(F.col("_rate").alias("rate"), net.alias("net"), tax.alias("tax")).cast(WORK_VAT)
    words = F.concat(F.lit("{rate: "), quantity("_rate"), F.lit(", net: "), money(net), F.lit(", tax: "), money(tax), F.lit("}"))
    log = (F.col("_rate").isNotNull(), _repair("R_VAT_SYNTH", "vatBreakdown.0", words))
    df = df.withColumns({"vat": F.when(F.col("_rate").isNotNull(), F.array(made)).otherwise(vat), "repairs": _log(log)}).drop("_rate")

    def gap(v: Column) -> Column:
        return v["net"].isNull() & v["rate"].isNotNull()

    # The header is better evidence than a rounded tax: apportion first.
    df = df.withColumn("_rest", F.when(net.isNotNull() & F.exists(vat, gap) & (F.size(F.filter(vat, gap)) == 1), (net - _sum(vat, lambda v: v["net"])).cast(AMOUNT)))
    filled = F.transform(vat, lambda v: F.when(gap(v), _entry(v, net=F.col("_rest"))).otherwise(v))
    log = _log_each(vat, lambda v, i: F.when(gap(v), _repair("R_VAT_SYNTH", _path("vatBreakdown", i, "net"), money("_rest"))))
    known = F.col("_rest").isNotNull()
    df = df.withColumns({"vat": _where(known, filled, "vat"), "repairs": _where(known, log, "repairs")}).drop("_rest")

    def new_tax(v: Column) -> Column:
        exact = v["net"] * v["rate"] * F.lit("0.01").cast("decimal(3,2)")
        return F.when(v["rate"].isNotNull() & v["tax"].isNull() & v["net"].isNotNull(), F.round(exact, 2).cast(AMOUNT))

    def new_net(v: Column) -> Column:
        return F.when(v["net"].isNull() & v["tax"].isNotNull() & (v["rate"] > 0), F.round(F.try_divide(v["tax"] * 100, v["rate"]), 2).cast(AMOUNT))

    def logged(v: Column, i: Column) -> Column:
        by_tax = F.when(new_tax(v).isNotNull(), _repair("R_VAT_SYNTH", _path("vatBreakdown", i, "tax"), money(new_tax(v))))
        return F.coalesce(by_tax, F.when(new_net(v).isNotNull(), _repair("R_VAT_SYNTH", _path("vatBreakdown", i, "net"), money(new_net(v)))))

    gaps = F.exists(vat, lambda v: v["net"].isNull() | v["tax"].isNull())
    filled = F.transform(vat, lambda v: _entry(v, tax=F.coalesce(v["tax"], new_tax(v)), net=F.coalesce(v["net"], new_net(v))))
    return df.withColumns({"repairs": _where(gaps, _log_each(vat, logged), "repairs"), "vat": _where(gaps, filled, "vat")})


def _fill_lines(df: DataFrame, field: str, name: str, new, rule, show) -> DataFrame:
    lines = F.col("lines")
    gaps = F.exists(lines, lambda x: x[field].isNull())
    log = _log_each(lines, lambda x, i: F.when(new(x).isNotNull(), F.struct(rule(x).alias("rule"), _path("lineItems", i, name).alias("path"), show(new(x)).alias("to"))))
    filled = F.transform(lines, lambda x: _line(x, **{field: F.coalesce(x[field], new(x))}))
    return df.withColumns({"repairs": _where(gaps, log, "repairs"), "lines": _where(gaps, filled, "lines")})


def line_total_derive(df: DataFrame, o: Reconcile) -> DataFrame:
    def new(x: Column) -> Column:
        return F.when(x["line_total"].isNull(), F.round(x["quantity"] * x["unit_price"], 2).cast(AMOUNT))

    return _fill_lines(df, "line_total", "lineTotal", new, lambda x: F.lit("R_LINETOTAL_DERIVE"), money)


def unit_price_derive(df: DataFrame, o: Reconcile) -> DataFrame:
    def new(x: Column) -> Column:
        return F.when(x["unit_price"].isNull() & (x["quantity"] != 0), F.round(F.try_divide(x["line_total"], x["quantity"]), 4).cast(AMOUNT))

    return _fill_lines(df, "unit_price", "unitPrice", new, lambda x: F.lit("R_UNITPRICE_DERIVE"), quantity)


def quantity_repair(df: DataFrame, o: Reconcile) -> DataFrame:
    line = F.lit(o.tolerance_line).cast("decimal(9,4)")

    def new(x: Column) -> Column:
        q = F.round(F.try_divide(x["line_total"], x["unit_price"]), 4).cast(AMOUNT)
        verified = F.when((x["unit_price"] != 0) & (F.abs(q * x["unit_price"] - x["line_total"]) <= line), q)
        alone = F.when(x["unit_price"].isNull() & x["line_total"].isNotNull(), F.lit(1).cast(AMOUNT))
        return F.when(x["quantity"].isNull(), F.coalesce(verified, alone))

    return _fill_lines(df, "quantity", "quantity", new, lambda x: F.when(new(x) == 1, F.lit("R_QTY_DEFAULT")).otherwise(F.lit("R_QTY_DERIVE")), quantity)


def line_tax_inherit(df: DataFrame, o: Reconcile) -> DataFrame:
    lines, vat, tax = map(F.col, ("lines", "vat", "tax"))
    rates = F.array_distinct(F.filter(F.transform(vat, lambda v: v["rate"]), lambda r: r.isNotNull()))
    one = F.when(F.size(rates) == 1, F.get(rates, F.lit(0)))
    implied = F.round(_sum_exact(lines, lambda x: x["line_total"] * F.coalesce(x["tax_rate"], one)) * F.lit("0.01").cast("decimal(3,2)"), 2)
    tolerance = F.lit(o.tolerance_header).cast("decimal(9,4)") + F.lit(o.slack_per_line).cast("decimal(9,4)") * F.size(lines)
    checkable = tax.isNotNull() & F.forall(lines, lambda x: x["line_total"].isNotNull())
    gaps = F.exists(lines, lambda x: x["tax_rate"].isNull())
    df = df.withColumn("_rate", F.when(gaps, F.when(~checkable | (F.abs(implied - tax) <= tolerance), one)))
    return _fill_lines(df, "tax_rate", "taxRate", lambda x: F.when(x["tax_rate"].isNull(), F.col("_rate")), lambda x: F.lit("R_LINE_TAX_INHERIT"), quantity).drop("_rate")


def _sum_exact(items: Column, value) -> Column:
    kind = "decimal(36,8)"
    return F.aggregate(items, F.lit(0).cast(kind), lambda a, x: (a + F.coalesce(value(x), F.lit(0)).cast(kind)).cast(kind))


RULES = (totals_from_vat, net_from_lines, total_derive, vat_synth, line_total_derive, unit_price_derive, quantity_repair, line_tax_inherit)


def repair(df: DataFrame, options: Reconcile = DEFAULT, rules=RULES) -> DataFrame:
    """The rules in their order, ``options.passes`` times."""
    for _ in range(options.passes):
        for rule in rules:
            df = rule(df, options)
    return df


def by_rate(lines: Column) -> Column:
    """The VAT breakdown of lines: net and tax of each rate, the highest first; lines without a rate or total are left
    out."""
    whole = F.filter(lines, lambda x: x["tax_rate"].isNotNull() & x["line_total"].isNotNull())
    rates = F.sort_array(F.array_distinct(F.transform(whole, lambda x: x["tax_rate"])), asc=False)

    def entry(r: Column) -> Column:
        net = _sum_exact(F.filter(whole, lambda x: x["tax_rate"] == r), lambda x: x["line_total"])
        return F.struct(r.alias("rate"), net.cast(AMOUNT).alias("net"), F.round(net * r * F.lit("0.01").cast("decimal(3,2)"), 2).cast(AMOUNT).alias("tax"))

    return F.transform(rates, entry).cast(f"array<{WORK_VAT}>")


def unresolved() -> Column:
    lines, vat = F.col("lines"), F.col("vat")
    rates = F.size(F.array_distinct(F.filter(F.transform(vat, lambda v: v["rate"]), lambda r: r.isNotNull())))

    def total(x: Column, i: Column) -> Column:
        words = F.concat(F.lit("line "), i.cast("string"), F.lit(' ("'), F.substring(x["description"], 1, 40), F.lit('") has no line total and none could be derived'))
        return F.when(x["line_total"].isNull(), _violation("LINE_TOTAL_UNRESOLVED", _paths(_path("lineItems", i, "lineTotal")), words))

    def rate(x: Column, i: Column) -> Column:
        words = F.concat(F.lit("line "), i.cast("string"), F.lit(" has no tax rate and the document has "), rates.cast("string"), F.lit(" VAT rates"))
        return F.when((rates > 1) & x["tax_rate"].isNull(), _violation("LINE_TAX_UNRESOLVED", _paths(_path("lineItems", i, "taxRate")), words))

    return F.filter(F.concat(F.transform(lines, total), F.transform(lines, rate)), lambda v: v.isNotNull())


def missing(required: dict[str, Column]) -> Column:
    """Violations for what a committed invoice must hold. ``required``: paths and values."""
    net, tax, gross, vat, lines = map(F.col, ("net", "tax", "gross", "vat", "lines"))
    found = [F.when(v.isNull(), _violation("REQUIRED_MISSING", _paths(p), F.lit(f"required field {p} was not extracted"))) for p, v in required.items()]
    found.append(F.when(net.isNull() | tax.isNull() | gross.isNull(), _violation("TOTALS_INCOMPLETE", _paths("totals"), F.lit("no combination of extracted amounts completes the totals"))))
    gaps = F.exists(vat, lambda v: v["rate"].isNull() | v["net"].isNull() | v["tax"].isNull())
    found.append(F.when(F.size(vat) == 0, _violation("VAT_MISSING", _paths("vatBreakdown"), F.lit("no VAT breakdown, and no single rate fits"))).when(gaps, _violation("VAT_INCOMPLETE", _paths("vatBreakdown"), F.lit("VAT entries lack a rate, a net or a tax"))))
    found.append(F.when(F.size(lines) == 0, _violation("LINE_ITEMS_MISSING", _paths("lineItems"), F.lit("no line items"))))
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def verdict(df: DataFrame, options: Reconcile = DEFAULT, required: dict[str, Column] | None = None) -> DataFrame:
    """``df``, which holds working columns, repaired, with total_failure, violations and status. ``total_failure`` is
    judged before repairs: some of C1 to C4 can be evaluated and none holds."""
    before = {k: c for k, c in checks(options).items() if k != "C5_VAT_CLOSED_SET"}
    some = F.array(*[c["evaluable"] for c in before.values()])
    good = F.array(*[c["holds"] for c in before.values()])
    df = df.withColumn("total_failure", F.exists(some, lambda x: x) & ~F.exists(good, lambda x: x))
    df = repair(df, options)
    df = df.withColumn("violations", F.concat(*[c["violations"] for c in checks(options).values()], unresolved(), missing(required or {})))
    df = df.withColumn("status", F.when(F.size("violations") == 0, "reconciled").otherwise("failed"))
    return df.withColumn("total_failure", F.col("total_failure") & (F.col("status") == "failed"))


def canonical(invoice: str = "invoice", options: Reconcile = DEFAULT) -> Column:
    """The canonical invoice of a working row: defaults, and amounts as strings."""
    c = F.col(invoice)

    def address(a: Column) -> Column:
        return F.when(a.isNotNull(), F.struct(*[clean(a[n]).alias(n) for n in ("street", "postal_code", "city", "country_code")]))

    seller, buyer = c["seller"], c["buyer"]
    vat = F.transform("vat", lambda v: F.struct(v["rate"].cast("double").alias("rate"), money(v["net"]).alias("net"), money(v["tax"]).alias("tax")))
    lines = F.transform(
        "lines",
        lambda x: F.struct(
            x["position"].alias("position"),
            x["description"].alias("description"),
            quantity(x["quantity"]).alias("quantity"),
            x["unit"].alias("unit"),
            quantity(x["unit_price"]).alias("unit_price"),
            x["tax_rate"].cast("double").alias("tax_rate"),
            money(x["line_total"]).alias("line_total"),
        ),
    )
    return F.struct(
        F.lit(1).alias("schema_version"),
        *[clean(c[n]).alias(n) for n in ("invoice_number", "issue_date", "due_date")],
        F.coalesce(clean(c["currency"]), F.lit(options.currency)).alias("currency"),
        clean(c["locale"]).alias("locale"),
        F.struct(*[clean(seller[n]).alias(n) for n in ("name", "vat_id", "tax_number")], F.coalesce(seller["ibans"], F.array().cast("array<string>")).alias("ibans"), address(seller["address"]).alias("address")).alias("seller"),
        F.when(buyer.isNotNull(), F.struct(*[clean(buyer[n]).alias(n) for n in ("name", "customer_number")], address(buyer["address"]).alias("address"))).alias("buyer"),
        F.struct(*[money(n).alias(n) for n in ("net", "tax", "gross")]).alias("totals"),
        vat.alias("vat_breakdown"),
        lines.alias("line_items"),
        clean(c["payment_terms"]).alias("payment_terms"),
    ).cast(CANONICAL)


def write_back(field_meta: Column) -> Column:
    """Provenance with an entry for each repaired path: source derived, confidence 0.9 times the least there is (0.9
    without any), within 0.1 and 1."""
    known = F.transform(F.map_values(field_meta), lambda m: m["confidence"])
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.9 * F.coalesce(F.array_min(known), F.lit(0.9))))
    paths = F.array_distinct(F.transform("repairs", lambda r: r["path"]))
    return F.map_from_arrays(paths, F.transform(paths, lambda _: F.struct(F.lit("derived").alias("source"), confidence.alias("confidence"))))


def reconcile(df: DataFrame, options: Reconcile = DEFAULT) -> DataFrame:
    """Envelopes (doc_id, invoice, field_meta) to results: status, invoice (canonical, null unless reconciled), repairs,
    violations, total_failure, derived (provenance of repaired paths)."""
    c = F.col("invoice")
    required = {"invoiceNumber": clean(c["invoice_number"]), "issueDate": clean(c["issue_date"]), "seller.name": clean(c["seller"]["name"])}
    df = verdict(load(df), options, required).withColumn("_canonical", canonical("invoice", options))
    issues = canonical_issues(F.col("_canonical"))
    df = df.withColumn("_issues", F.when(F.col("status") == "reconciled", issues).otherwise(F.array().cast("array<string>")))
    bad = F.size("_issues") > 0
    df = df.withColumns({"violations": F.when(bad, F.array(_violation("SCHEMA_INVALID", F.col("_issues"), F.array_join("_issues", "; ")))).otherwise(F.col("violations")), "status": F.when(bad, "failed").otherwise(F.col("status"))})
    df = df.withColumns({"derived": write_back(F.col("field_meta")), "invoice": F.when(F.col("status") == "reconciled", F.col("_canonical"))})
    return df.select("doc_id", "status", "invoice", "repairs", "violations", "total_failure", "derived")
