"""Vendors: which template a document's identifiers find, and how templates are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: The identifiers by which a vendor is looked up, strongest first.
TIERS = ("vat_id", "tax_number", "iban", "name_hash")


def keys(ids: Column) -> Column:
    """(tier, value) of every identifier there is; ``ids`` has vat_id, tax_number, ibans, name_hash."""
    def key(tier: int, value: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), value.alias("value"))

    single = F.array(*[key(i, ids[n]) for i, n in ((0, "vat_id"), (1, "tax_number"), (3, "name_hash"))])
    ibans = F.transform(F.coalesce(ids["ibans"], F.array().cast("array<string>")), lambda v: key(2, v))
    return F.filter(F.concat(single, ibans), lambda k: k["value"].isNotNull() & (k["value"] != ""))


def resolve(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """``docs`` (doc_id, ids) with template_id and matched_by of the strongest identifier that any template holds; among
    equals the least template_id. Templates hold template_id and ids. One equi-join over (tier, value)."""
    asked = docs.select("doc_id", F.explode(keys(F.col("ids"))).alias("k")).select("doc_id", "k.tier", "k.value")
    held = templates.select("template_id", F.explode(keys(F.col("ids"))).alias("k")).groupBy("k.tier", "k.value").agg(F.min("template_id").alias("template_id"))
    best = asked.join(held, ["tier", "value"]).groupBy("doc_id").agg(F.min(F.struct("tier", "template_id")).alias("best"))
    name = F.when(F.col("best").isNotNull(), F.get(F.array(*map(F.lit, TIERS)), F.col("best.tier")))
    return docs.join(best, "doc_id", "left").select(*docs.columns, F.col("best.template_id").alias("template_id"), name.alias("matched_by"))


def claims(observed: DataFrame) -> DataFrame:
    """iban and the template that claimed it first: rows (iban, template_id, seq); ties go to the lesser template."""
    return observed.groupBy("iban").agg(F.min(F.struct("seq", "template_id")).alias("first")).select("iban", F.col("first.template_id").alias("template_id"))


def conflict(matched_by: Column, new: Column, old: Column) -> Column:
    """A weak match whose strong identifiers differ is another vendor."""
    weak = matched_by.isin("iban", "name_hash")
    return weak & (F.coalesce(new["vat_id"] != old["vat_id"], F.lit(False)) | F.coalesce(new["tax_number"] != old["tax_number"], F.lit(False)))


def upsert(templates: DataFrame, induced: DataFrame) -> DataFrame:
    """The template table after a batch: rows (template_id, ids, body, version, source). ``induced`` holds doc_id, seq,
    ids, body and source; all of a batch resolve against the table as it is at its start. Those of one target are
    folded in the order of seq: identifiers merge, the last body stays, and the version grows by each. Conflicting and
    unknown ones become new templates, one for each strongest identifier."""
    found = resolve(induced, templates).join(templates.select("template_id", F.col("ids").alias("old")), "template_id", "left")
    own = found.withColumn("_new", F.col("template_id").isNull() | F.coalesce(conflict(F.col("matched_by"), F.col("ids"), F.col("old")), F.lit(False)))
    strongest = let(F.array_min(keys(F.col("ids"))), lambda k: F.concat_ws(":", k["tier"].cast("string"), k["value"]))
    target = F.when(F.col("_new"), F.concat(F.lit("new:"), F.coalesce(strongest, F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))))).otherwise(F.col("template_id").cast("string"))
    # Of a target's documents only the last body, each identifier's last value, the accounts and their number count.
    order = F.struct("seq", "doc_id")
    accounts = F.transform(F.coalesce("ids.ibans", F.array().cast("array<string>")), lambda v: F.struct(v.alias("iban")))
    own = own.withColumns({"_target": target, "_order": order})

    def last_known(name: str) -> Column:
        return F.max(F.when(F.col(f"ids.{name}").isNotNull(), F.struct("_order", F.col(f"ids.{name}").alias("v"))))["v"].alias(f"_{name}")

    batch = own.groupBy("_target").agg(F.max_by("body", "_order").alias("_body"), F.max_by("source", "_order").alias("_source"), F.count("*").cast("int").alias("_n"), *[last_known(n) for n in ("vat_id", "tax_number", "name_hash")])
    seen = own.select("_target", "_order", F.posexplode(accounts).alias("_at", "_a")).groupBy("_target", F.col("_a.iban").alias("iban")).agg(F.min(F.struct("_order", "_at")).alias("first"))
    listed = seen.groupBy("_target").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "iban"))), lambda x: x["iban"]).alias("_ibans"))  # distinct accounts of one vendor
    stored = templates.withColumn("_target", F.col("template_id").cast("string"))
    both = stored.join(batch.join(listed, "_target", "left"), "_target", "full_outer")
    none = F.array().cast("array<string>")
    merged = F.struct(*[F.coalesce(f"_{n}", F.col(f"ids.{n}")).alias(n) for n in ("vat_id", "tax_number")], F.array_union(F.coalesce("ids.ibans", none), F.coalesce("_ibans", none)).alias("ibans"), F.coalesce("_name_hash", F.col("ids.name_hash")).alias("name_hash"))
    kind = "struct<vat_id:string,tax_number:string,ibans:array<string>,name_hash:string>"
    ids = F.when(F.col("_n").isNull(), F.col("ids").cast(kind)).otherwise(merged.cast(kind))
    grown = F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return both.select(F.col("_target").alias("template_id"), ids.alias("ids"), F.coalesce("_body", "body").alias("body"), grown.alias("version"), F.coalesce("_source", "source").alias("source"))


def unclaimed(new_links: DataFrame, links: DataFrame) -> DataFrame:
    """Links (iban, template_id, seq) whose account no template has claimed yet, one for each account."""
    return claims(new_links).join(links.select("iban"), "iban", "left_anti")


def latest(templates: DataFrame, limit: int = 100) -> DataFrame:
    """Newest-updated first: ids and the vendor's name without the body."""
    rows = templates.orderBy(F.desc("updated_at"), "template_id").limit(limit)
    return rows.select("template_id", "ids", F.col("body.vendor_ids.display_name").alias("display_name"), "updated_at")
