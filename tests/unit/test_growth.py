"""Work that must grow with the input and no faster: large documents within seconds, and small tables over all cores."""

import json
import time

import pytest
from pyspark.sql import functions as F

from paperledger.functions import amounts
from paperledger.operators import layout, reconcile, records, template
from paperledger.plans import schemas
from paperledger.queries import QUERIES, invoices, layouts, load_all, stages, texts
from paperledger.sources import ports

DATA = "/root/testdata/sf0.001"
load_all()


def words(n, columns=4):
    """A scan of ``n`` words in rows of some columns, headings first."""
    out = []
    for i in range(n):
        row, c = divmod(i, columns)
        text = ("Pos", "Bezeichnung", "Menge", "Betrag")[c] if row == 0 else (str(row), f"Ware {row}", "2", f"{row},00")[c]
        box = {"x0": 0.1 + 0.2 * c, "y0": 0.01 * row, "x1": 0.2 + 0.2 * c, "y1": 0.01 * row + 0.001}
        out.append({"ix": i, "text": text, "page": 1, "box": box, "tag": None, "tokens": [{"text": text, "page": 1, "box": box}]})
    return out


def within(seconds, df, column):
    began = time.perf_counter()
    got = df.select(column.alias("v")).first().v
    assert time.perf_counter() - began < seconds
    return got


def test_a_layout_table_of_many_cells(spark):
    cells = [{"text": f"{r}.{c}", "start_row_offset_idx": r, "start_col_offset_idx": c, "column_header": r == 0} for r in range(40) for c in range(20)]
    prov = [{"page_no": 1, "bbox": {"l": 0, "t": 0, "r": 10, "b": 10}}]
    text = json.dumps({"pages": {"1": {"page_no": 1}}, "texts": [], "tables": [{"prov": prov, "data": {"num_rows": 40, "num_cols": 20, "table_cells": cells}}]})
    df = ports.read_layout(spark.createDataFrame([(text,)], "layout_json string"))
    got = within(30, df, F.get("tables", F.lit(0)))
    assert got.header == [f"0.{c}" for c in range(20)] and got.rows == [[f"{r}.{c}" for c in range(20)] for r in range(1, 40)]


def test_a_scan_of_many_words(spark):
    df = spark.createDataFrame([(words(320),)], f"lines array<{schemas.LINE}>")
    merged = within(30, df, layout.merged_lines(F.col("lines")))
    assert len(merged) == 80 and merged[0].text == "Pos Bezeichnung Menge Betrag" and merged[79].text == "79 Ware 79 2 79,00"


@pytest.mark.parametrize("rows", [lambda s: texts.amounts(s, DATA), lambda s: stages.keys(s, DATA), lambda s: layouts.tables(s, DATA), lambda s: layouts.tokens(s, DATA), lambda s: invoices.working(s, DATA), lambda s: layouts.paged(s, DATA)], ids=["amounts", "keys", "tables", "tokens", "working", "paged"])
def test_rows_are_dealt_over_all_cores(spark, rows):
    """A file of one row group, or a shuffle of few bytes, is one task otherwise."""
    assert rows(spark).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("text,decimal,value", [("12", None, "12"), ("-7", None, "-7"), ("1.234,5", None, "1234.5"), ("1,234,567.89", None, "1234567.89"), ("1.234", None, "1234"), ("0012,30", None, "0012.30"), ("1.234", ".", "1.234"), ("12,34", ".", "1234"), ("1.234,56", ",", "1234.56"), ("12.34", ",", "1234"), ("1234567890123", None, None), ("-1.234,56", None, "-1234.56"), ("1,5", None, "1.5"), ("1.23,4", None, "123.4"), ("12\n", None, "12")])
def test_plain_amounts_read_as_before(spark, text, decimal, value):
    pinned = None if decimal is None else F.lit(decimal)
    assert spark.range(1).select(amounts.parse_amount(F.lit(text), pinned).alias("v")).first().v == value


def test_an_idle_pass_leaves_a_row_as_it_is(spark):
    line = "struct(1 AS position, 'x' AS description, 1.0000BD AS quantity, 'pc' AS unit, 2.0000BD AS unit_price, 19.0000BD AS tax_rate, 2.0000BD AS line_total)"
    df = spark.range(1).select(*[F.expr(e).cast(t).alias(n) for n, e, t in (("net", "2", schemas.AMOUNT), ("tax", "0.38", schemas.AMOUNT), ("gross", "2.38", schemas.AMOUNT), ("vat", "array(struct(19.0000BD AS rate, 2.0000BD AS net, 0.3800BD AS tax))", f"array<{schemas.WORK_VAT}>"), ("lines", f"array({line})", f"array<{schemas.WORK_LINE}>"), ("repairs", "array()", f"array<{schemas.REPAIR}>"))])
    before, after = df.first(), reconcile.repair(df).first()
    assert before.asDict() == after.asDict()


def test_a_template_learns_from_a_large_table(spark):
    rows = [[str(i), f"Ware {i:04d}", "2", f"{i + 1},00"] for i in range(60)]
    items = [{"position": i, "description": f"Ware {i:04d}", "quantity": "2", "unit": None, "unit_price": None, "tax_rate": None, "line_total": f"{i + 1}.00"} for i in range(60)]
    table = {"page": 1, "box": None, "header": ["Pos", "Bezeichnung", "Menge", "Betrag"], "rows": rows}
    df = spark.createDataFrame([(items, [table])], f"items array<{schemas.ITEM}>, tables array<{schemas.TABLE}>")
    got = within(60, df, template.induce_table(F.col("items"), F.col("tables"), F.lit(",")))
    assert got.columns == {"position": 0, "description": 1, "quantity": 2, "line_total": 3}


def test_documents_without_a_parent_do_not_meet_in_one_task(spark):
    given = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 1, F.col("id") - 1).alias("parent_id"))
        files = spark.range(0, 400, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id")).alias("content"))
        got = records.with_parent_content(docs, files)
        assert max(map(len, got.rdd.glom().collect())) < 200
        assert {r.doc_id: r.content for r in got.collect()} == {i: f"own {i}" if i % 2 == 0 else f"own {i - 1}" if i % 100 == 1 else None for i in range(400)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_e_invoices_and_gated_texts_are_dealt_over_all_cores(spark):
    least = 3 * spark.sparkContext.defaultParallelism
    assert texts.gated(spark, DATA).rdd.getNumPartitions() >= least
    assert QUERIES["cii_parse"](spark, DATA).rdd.getNumPartitions() >= least
