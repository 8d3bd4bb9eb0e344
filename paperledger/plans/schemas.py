"""Fixed schemas. Nothing is inferred from data."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TOKEN = f"struct<text:string,page:int,box:{BOX}>"
LINE = f"struct<ix:int,text:string,page:int,box:{BOX},tag:string,tokens:array<{TOKEN}>>"
TABLE = f"struct<page:int,box:{BOX},header:array<string>,rows:array<array<string>>>"
POSITIONED = f"doc_id string, page_count int, lines array<{LINE}>, tables array<{TABLE}>, markdown string"

ADDRESS = "struct<street:string,postal_code:string,city:string,country_code:string>"
SELLER = f"struct<name:string,vat_id:string,tax_number:string,ibans:array<string>,address:{ADDRESS}>"
BUYER = f"struct<name:string,customer_number:string,address:{ADDRESS}>"
TOTALS = "struct<net:string,tax:string,gross:string>"
VAT = "struct<rate:double,net:string,tax:string>"
ITEM = "struct<position:int,description:string,quantity:string,unit:string,unit_price:string,tax_rate:double,line_total:string>"
INVOICE = (
    f"struct<invoice_number:string,issue_date:string,due_date:string,currency:string,locale:string,seller:{SELLER},buyer:{BUYER},"
    f"totals:{TOTALS},vat_breakdown:array<{VAT}>,line_items:array<{ITEM}>,payment_terms:string>"
)
CANONICAL = INVOICE.replace("struct<", "struct<schema_version:int,", 1)
META = f"struct<source:string,confidence:double,raw_text:string,page:int,box:{BOX}>"
ENVELOPE = f"doc_id string, invoice {INVOICE}, field_meta map<string,{META}>"

AMOUNT = "decimal(18,4)"
RATE = "decimal(9,4)"
WORK_VAT = f"struct<rate:{RATE},net:{AMOUNT},tax:{AMOUNT}>"
WORK_LINE = f"struct<position:int,description:string,quantity:{AMOUNT},unit:string,unit_price:{AMOUNT},tax_rate:{RATE},line_total:{AMOUNT}>"
REPAIR = "struct<rule:string,path:string,to:string>"
VIOLATION = "struct<constraint:string,paths:array<string>,detail:string,delta:string,hint:string>"

FIELD = f"struct<label:string,value_pattern:string,page:int,box:{BOX}>"
ITEM_TABLE = "struct<header:array<string>,columns:map<string,int>,continuation:string>"
VENDOR_IDS = "struct<vat_id:string,tax_number:string,ibans:array<string>,name_hash:string,display_name:string>"
TEMPLATE = f"struct<template_version:int,vendor_ids:{VENDOR_IDS},decimal:string,date_formats:array<string>,fields:map<string,{FIELD}>,item_table:{ITEM_TABLE}>"

#: The names of sources, statuses, routes and stages that stored rows hold.
SOURCES = ("zugferd", "template", "rules", "ocr", "vlm", "human", "derived")
STATUSES = ("received", "routed", "extracted", "segmented", "escalated_vlm", "pending_review", "committed", "exported_markdown", "failed")
ROUTES = ("zugferd", "text", "image")
MONEY_SHAPE, QUANTITY_SHAPE, DATE_SHAPE = r"^-?[0-9]{1,12}(\.[0-9]{1,2})?$", r"^-?[0-9]{1,12}(\.[0-9]{1,4})?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def struct_type(ddl: str) -> T.DataType:
    return T.DataType.fromDDL(ddl) if hasattr(T.DataType, "fromDDL") else T._parse_datatype_string(ddl)


def json_schema(ddl: str) -> dict:
    """The JSON Schema of a type: every key is present, null is allowed but where the type forbids it."""
    def of(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t}, "required": [f.name for f in t], "additionalProperties": False}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, T.MapType):
            return {"type": "object", "additionalProperties": of(t.valueType)}
        return {"type": ["integer" if isinstance(t, (T.IntegerType, T.LongType)) else "number" if isinstance(t, T.DoubleType) else "boolean" if isinstance(t, T.BooleanType) else "string", "null"]}

    return of(struct_type(ddl))


def json_schema_text(ddl: str) -> str:
    return json.dumps(json_schema(ddl), sort_keys=True)


def canonical_issues(c: Column) -> Column:
    """What keeps a canonical invoice from its schema, as an array of texts; empty if nothing does."""
    def bad(path: str, wrong: Column) -> Column:
        return F.when(F.coalesce(wrong, F.lit(True)), F.lit(path))

    def unless(value: Column, shape: str) -> Column:
        return value.isNotNull() & ~value.rlike(shape)

    checks = [
        bad("invoice_number", c["invoice_number"].isNull() | (c["invoice_number"] == "")),
        bad("issue_date", c["issue_date"].isNull() | ~c["issue_date"].rlike(DATE_SHAPE)),
        bad("due_date", unless(c["due_date"], DATE_SHAPE)),
        bad("currency", F.length(c["currency"]) != 3),
        bad("seller.name", c["seller"]["name"].isNull() | (c["seller"]["name"] == "")),
        bad("seller.address.country_code", c["seller"]["address"]["country_code"].isNotNull() & (F.length(c["seller"]["address"]["country_code"]) != 2)),
        bad("buyer.address.country_code", c["buyer"]["address"]["country_code"].isNotNull() & (F.length(c["buyer"]["address"]["country_code"]) != 2)),
        *[bad(f"totals.{n}", ~c["totals"][n].rlike(MONEY_SHAPE)) for n in ("net", "tax", "gross")],
        bad("vat_breakdown", F.size(c["vat_breakdown"]) < 1),
        bad("vat_breakdown.rate", F.exists(c["vat_breakdown"], lambda v: F.coalesce(~v["rate"].between(0, 100), F.lit(True)))),
        bad("vat_breakdown.amounts", F.exists(c["vat_breakdown"], lambda v: F.coalesce(~(v["net"].rlike(MONEY_SHAPE) & v["tax"].rlike(MONEY_SHAPE)), F.lit(True)))),
        bad("line_items", F.size(c["line_items"]) < 1),
        bad("line_items.description", F.exists(c["line_items"], lambda x: F.coalesce(x["description"] == "", F.lit(True)))),
        bad("line_items.line_total", F.exists(c["line_items"], lambda x: F.coalesce(~x["line_total"].rlike(MONEY_SHAPE), F.lit(True)))),
        bad("line_items.quantity", F.exists(c["line_items"], lambda x: unless(x["quantity"], QUANTITY_SHAPE))),
        bad("line_items.unit_price", F.exists(c["line_items"], lambda x: unless(x["unit_price"], QUANTITY_SHAPE))),
        bad("line_items.tax_rate", F.exists(c["line_items"], lambda x: x["tax_rate"].isNotNull() & ~x["tax_rate"].between(0, 100))),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
