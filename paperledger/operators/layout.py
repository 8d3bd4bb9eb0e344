"""Positioned text: from layout JSON, and words merged into visual lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, let, trim
from ..plans.schemas import BOX, LINE, TABLE, TOKEN

#: How far apart centres of one line may be, and the page that is assumed where none is declared.
TOLERANCE = 0.008
PAGE_WIDTH, PAGE_HEIGHT, FIT = 595.276, 841.89, 2.0

_PROV = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>"
_CELL = "struct<text:string,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int,column_header:boolean>"
LAYOUT = (
    f"struct<texts:array<struct<label:string,text:string,orig:string,prov:{_PROV}>>,"
    f"tables:array<struct<prov:{_PROV},data:struct<num_rows:int,num_cols:int,table_cells:array<{_CELL}>>>>,"
    "pages:map<string,struct<size:struct<width:double,height:double>,page_no:int>>>"
)


def normal_box(b: Column, size: Column) -> Column:
    """A box in points as shares of its page, from the top left, within 0 and 1; null where no page size is declared
    and the box does not fit the assumed page."""
    def of(b: Column, size: Column) -> Column:
        declared = size["width"].isNotNull() & size["height"].isNotNull()
        fits = (F.greatest(b["l"], b["r"]) <= PAGE_WIDTH + FIT) & (F.greatest(b["t"], b["b"]) <= PAGE_HEIGHT + FIT)
        up = F.upper(F.coalesce(b["coord_origin"], F.lit("TOPLEFT"))) == "BOTTOMLEFT"
        return F.when(declared | fits, bound(scaled, b, F.coalesce(size["width"], F.lit(PAGE_WIDTH)), F.coalesce(size["height"], F.lit(PAGE_HEIGHT)), up))

    def scaled(b: Column, w: Column, h: Column, up: Column) -> Column:
        def made(y0: Column, y1: Column) -> Column:
            return F.struct(clamp(b["l"] / w).alias("x0"), clamp(F.least(y0, y1)).alias("y0"), clamp(b["r"] / w).alias("x1"), clamp(F.greatest(y0, y1)).alias("y1")).cast(BOX)

        return bound(made, F.when(up, h - b["t"]).otherwise(b["t"]) / h, F.when(up, h - b["b"]).otherwise(b["b"]) / h)

    def clamp(v: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    return bound(of, b, size)


def _in_reading_order(lines: Column) -> Column:
    """By page, top and left; equal ones keep their order."""
    keyed = F.transform(lines, lambda x, i: F.struct(x["page"].alias("page"), x["box"]["y0"].alias("y"), x["box"]["x0"].alias("x"), i.alias("i"), x.alias("line")))
    return F.transform(F.sort_array(keyed), lambda k, i: k["line"].withField("ix", i.cast("int")))


def map_layout(layout: Column) -> Column:
    """page_count, lines, tables and error of a parsed layout, as a struct. ``error`` names a page whose scale would be
    a guess."""
    return let(layout, lambda parsed: bound(_mapped, _page_count(parsed["pages"]), _lines(parsed), _tables(parsed)))


def _mapped(page_count: Column, lines: Column, tables: Column) -> Column:
    lost = F.exists(lines, lambda x: x["box"].isNull()) | F.exists(tables, lambda t: t["box"].isNull())
    error = F.when(lost, F.lit("no page size is declared and boxes do not fit the assumed page"))
    return F.struct(page_count.alias("page_count"), _in_reading_order(lines).alias("lines"), tables.alias("tables"), error.alias("error"))


def _page_count(pages: Column) -> Column:
    counts = F.transform(F.map_values(pages), lambda p: F.coalesce(p["page_no"], F.lit(0)))
    return F.greatest(F.lit(1), F.coalesce(F.array_max(counts), F.lit(0)))


def _size(layout: Column, page: Column) -> Column:
    return F.try_element_at(layout["pages"], page.cast("string"))["size"]


def _lines(layout: Column) -> Column:
    def line(t: Column) -> Column:
        def made(prov: Column, text: Column) -> Column:
            return let(normal_box(prov["bbox"], _size(layout, prov["page_no"])), lambda box: placed(prov, text, box))

        def placed(prov: Column, text: Column, box: Column) -> Column:
            token = F.struct(text.alias("text"), prov["page_no"].alias("page"), box.alias("box")).cast(TOKEN)
            return F.struct(F.lit(0).alias("ix"), text.alias("text"), prov["page_no"].alias("page"), box.alias("box"), t["label"].alias("tag"), F.array(token).alias("tokens")).cast(LINE)

        return bound(made, F.get(t["prov"], F.lit(0)), trim(F.coalesce(t["text"], t["orig"], F.lit(""))))

    texts = F.coalesce(layout["texts"], F.array().cast("array<struct<label:string,text:string,orig:string,prov:" + _PROV + ">>"))
    return F.filter(F.transform(F.filter(texts, lambda t: F.size(t["prov"]) > 0), line), lambda x: x["text"] != "")


def _tables(layout: Column) -> Column:
    tables = F.filter(F.coalesce(layout["tables"], F.array()), lambda t: (F.size(t["prov"]) > 0) & (t["data"]["num_rows"] > 0) & (t["data"]["num_cols"] > 0) & t["data"]["table_cells"].isNotNull())

    def table(t: Column) -> Column:
        prov, d = F.get(t["prov"], F.lit(0)), t["data"]

        def spanned(x: Column) -> Column:
            """A cell's text and the rows and columns that it covers: from the first, up to the one after the last."""
            def upto(kind: str, most: Column) -> Column:
                return F.least(F.coalesce(x[f"end_{kind}_offset_idx"], F.coalesce(x[f"start_{kind}_offset_idx"], F.lit(0)) + 1), most)

            return F.struct(
                trim(F.coalesce(x["text"], F.lit(""))).alias("text"), F.coalesce(x["column_header"], F.lit(False)).alias("head"),
                F.coalesce(x["start_row_offset_idx"], F.lit(0)).alias("r0"), upto("row", d["num_rows"]).alias("r1"),
                F.coalesce(x["start_col_offset_idx"], F.lit(0)).alias("c0"), upto("col", d["num_cols"]).alias("c1"),
            )

        def filled(cells: Column) -> Column:
            rows, columns = F.sequence(F.lit(0), d["num_rows"] - 1), F.sequence(F.lit(0), d["num_cols"] - 1)

            def row(r: Column) -> Column:
                def cell(own: Column, c: Column) -> Column:
                    return F.array_join(F.transform(F.filter(own, lambda x: (c >= x["c0"]) & (c < x["c1"])), lambda x: x["text"]), " ")

                def cut(own: Column) -> Column:
                    texts = F.filter(own, lambda x: x["text"] != "")
                    return F.struct(let(texts, lambda o: F.transform(columns, lambda c: cell(o, c))).alias("cells"), F.exists(own, lambda x: x["head"]).alias("head"))

                return let(F.filter(cells, lambda x: (r >= x["r0"]) & (r < x["r1"])), cut)

            return bound(told, F.transform(rows, row), columns)

        def told(grid: Column, columns: Column) -> Column:
            heads = F.filter(F.transform(grid, lambda g, i: F.when(g["head"], i)), lambda i: i.isNotNull())
            return let(heads, lambda heads: cut_off(grid, columns, heads))

        def cut_off(grid: Column, columns: Column, heads: Column) -> Column:
            merged = F.transform(columns, lambda c: trim(F.array_join(F.filter(F.transform(heads, lambda r: F.get(F.get(grid, r)["cells"], c)), lambda w: w != ""), " ")))
            header = F.when(F.size(heads) > 0, merged).otherwise(F.get(grid, F.lit(0))["cells"])
            start = F.when(F.size(heads) > 0, F.array_max(heads) + 1).otherwise(F.lit(1))
            body = let(start, lambda start: F.transform(F.filter(grid, lambda _, i: i >= start), lambda g: g["cells"]))
            return F.struct(prov["page_no"].alias("page"), normal_box(prov["bbox"], _size(layout, prov["page_no"])).alias("box"), header.alias("header"), body.alias("rows")).cast(TABLE)

        return let(F.transform(d["table_cells"], spanned), filled)

    return F.transform(tables, table)


def merge_lines(lines: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (doc_id, page, ix, text, x0, y0, x1, y1, tag) to one row per visual line: doc_id, page, line (from 0 in
    reading order), text, box and n. A line goes on while each centre is within ``tolerance`` of the one before, so a
    ladder of small steps is one line. Pages are the groups; ties keep the order of ``ix``."""
    y = (F.col("y0") + F.col("y1")) / 2
    down = Window.partitionBy("doc_id", "page").orderBy("_y", "ix")
    t = lines.withColumn("_y", y).withColumn("_new", F.coalesce((F.abs(F.col("_y") - F.lag("_y").over(down)) > tolerance).cast("int"), F.lit(1)))
    t = t.withColumn("_group", F.sum("_new").over(down))
    part = F.struct("x0", "_y", "ix", "text", "tag")
    t = t.groupBy("doc_id", "page", "_group").agg(F.sort_array(F.collect_list(part)).alias("_parts"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "_group")
    tags = F.filter(F.transform("_parts", lambda p: p["tag"]), lambda x: x.isNotNull())
    return t.select("doc_id", "page", (F.row_number().over(order) - 1).alias("line"), F.array_join(F.transform("_parts", lambda p: p["text"]), " ").alias("text"), F.struct("x0", "y0", "x1", "y1").alias("box"), F.get(tags, F.lit(0)).alias("tag"), F.size("_parts").alias("n"))


def merged_lines(lines: Column, tolerance: float = TOLERANCE) -> Column:
    """The same within a row, tokens kept, for documents whose lines are an array."""
    def marked(keyed: Column) -> Column:
        def starts(k: Column, i: Column) -> Column:
            return let(F.get(keyed, i - 1), lambda last: (i == 0) | (last["page"] != k["page"]) | (F.abs(k["y"] - last["y"]) > tolerance))

        marks = F.filter(F.transform(keyed, lambda k, i: F.when(starts(k, i), i)), lambda i: i.isNotNull())
        return let(marks, lambda marks: F.transform(marks, lambda at, n: parted(keyed, at, F.coalesce(F.get(marks, n + 1), F.size(keyed)))))

    def parted(keyed: Column, at: Column, end: Column) -> Column:
        parts = F.sort_array(F.transform(F.slice(keyed, at + 1, end - at), lambda k: F.struct(k["line"]["box"]["x0"].alias("x"), k["y"].alias("y"), k["i"].alias("i"), k["line"].alias("line"))))
        return let(parts, line)

    def line(parts: Column) -> Column:
        def edge(name: str) -> Column:
            return F.transform(parts, lambda p: p["line"]["box"][name])

        box = F.struct(F.array_min(edge("x0")).alias("x0"), F.array_min(edge("y0")).alias("y0"), F.array_max(edge("x1")).alias("x1"), F.array_max(edge("y1")).alias("y1"))
        tags = F.filter(F.transform(parts, lambda p: p["line"]["tag"]), lambda x: x.isNotNull())
        tokens = F.flatten(F.transform(parts, lambda p: p["line"]["tokens"]))
        text = F.array_join(F.transform(parts, lambda p: p["line"]["text"]), " ")
        return F.struct(F.lit(0).alias("ix"), text.alias("text"), F.get(parts, F.lit(0))["line"]["page"].alias("page"), box.alias("box"), F.get(tags, F.lit(0)).alias("tag"), tokens.alias("tokens")).cast(LINE)

    keyed = F.sort_array(F.transform(lines, lambda x, i: F.struct(x["page"].alias("page"), ((x["box"]["y0"] + x["box"]["y1"]) / 2).alias("y"), i.alias("i"), x.alias("line"))))
    return _in_reading_order(let(keyed, marked))


def too_large(width: Column, height: Column, most_pixels: float = 25e6) -> Column:
    """Whether a page's raster would exceed the limit; asked before any memory is taken."""
    return F.ceil(width) * F.ceil(height) > most_pixels


def band_of(x0: Column, x1: Column, starts: Column) -> Column:
    """The column band of a token by greatest overlap, ties to the right. ``starts``: ascending left edges; the outer
    bands are open. A token of no width falls into the band that holds its left edge, if any."""
    def of(x0: Column, x1: Column, starts: Column) -> Column:
        n = F.size(starts)

        def overlap(s: Column, i: Column) -> Column:
            low = F.when(i == 0, F.lit(float("-inf"))).otherwise(s)
            high = F.when(i == n - 1, F.lit(float("inf"))).otherwise(F.get(starts, i + 1))
            return F.struct((F.least(x1, high) - F.greatest(x0, low)).alias("overlap"), i.alias("i"))

        inside = F.array_max(F.filter(F.transform(starts, lambda s, i: F.when((i == 0) | (s <= x0), i)), lambda i: i.isNotNull()))
        best = let(F.array_max(F.transform(starts, overlap)), lambda best: F.when(best["overlap"] >= 2.220446049250313e-16, best["i"]).otherwise(inside))
        return F.when(n > 0, best)

    return bound(of, x0, x1, starts)
