"""Line items from a table whose columns are known, shared by templates and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.text import clean, let, trim
from ..plans.schemas import ITEM

#: The columns of a table of items, in the order in which they are assigned.
COLUMNS = ("description", "line_total", "unit_price", "quantity", "position", "tax_rate", "unit")
NO_NUMBER = "rowsWithoutPosNumber"


def line_items(rows: Column, columns: Column, continuation: Column, decimal: Column | None = None) -> Column:
    """Items of an array of rows. ``columns``: an index for each of COLUMNS, or null. Under the continuation mode, a row
    with a description and neither a number nor amounts continues the item before it; the first row never does. Rows
    without a description are dropped."""
    def number(value: Column) -> Column:
        return parse_amount(value, decimal) if decimal is not None else parse_amount(value)

    def cells(c: Column, row: Column) -> Column:
        return F.struct(*[F.when(F.get(c, F.lit(i)).isNotNull(), clean(F.get(row, F.get(c, F.lit(i))))).alias(n) for i, n in enumerate(COLUMNS)])

    def add(c: Column, items: Column, v: Column) -> Column:
        numeric = F.coalesce(v["position"].rlike("^[0-9]+$"), F.lit(False))
        bare = v["quantity"].isNull() & v["unit_price"].isNull() & v["line_total"].isNull()
        goes_on = (continuation == NO_NUMBER) & F.get(c, F.lit(COLUMNS.index("position"))).isNotNull() & ~numeric & v["description"].isNotNull() & bare & (F.size(items) > 0)
        last = F.try_element_at(items, F.lit(-1))
        joined = last.withField("description", trim(F.concat_ws(" ", last["description"], v["description"])))
        item = F.struct(
            F.when(numeric, v["position"].try_cast("int")).alias("position"),
            v["description"].alias("description"),
            number(v["quantity"]).alias("quantity"),
            v["unit"].alias("unit"),
            number(v["unit_price"]).alias("unit_price"),
            number(F.replace(v["tax_rate"], F.lit("%"), F.lit(""))).try_cast("double").alias("tax_rate"),
            number(v["line_total"]).alias("line_total"),
        ).cast(ITEM)
        grown = F.concat(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), F.array(joined))
        return F.when(F.coalesce(goes_on, F.lit(False)), grown).when(v["description"].isNull(), items).otherwise(F.concat(items, F.array(item)))

    def fold(c: Column) -> Column:
        return F.aggregate(rows, F.array().cast(f"array<{ITEM}>"), lambda items, row: let(cells(c, row), lambda v: add(c, items, v)))

    return let(columns, fold)
