"""Sources, sinks and the ports behind which other systems stand.

Portable documents, rasters, layout conversion and vision models are not part of this engine: each is a port, a
callable from DataFrame to DataFrame that a deployment supplies. Tables take their place in tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_fences
from ..operators.layout import LAYOUT, map_layout
from ..operators.records import MOST_BYTES, content_hash
from ..plans.schemas import CANONICAL

Port = Callable[[DataFrame], DataFrame]

#: Names of attachments that hold an e-invoice. The last two are found anywhere in a name.
ATTACHMENT = r"(?i)^factur-x\.xml$|^zugferd-invoice\.xml$|^xrechnung\.xml$|zugferd.*\.xml|factur-?x.*\.xml"


def is_invoice_attachment(name: Column) -> Column:
    return F.coalesce(name.rlike(ATTACHMENT), F.lit(False))


def read_files(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Files of a folder with their hash: doc_id (the path), filename, content, content_hash, created_at. Files over
    the limit stay out, and so do empty ones."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sized = files.where((F.col("length") > 0) & (F.col("length") <= MOST_BYTES))
    return sized.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content", content_hash(F.col("content")).alias("content_hash"), F.col("modificationTime").alias("created_at"))


def embedded_xml(df: DataFrame) -> DataFrame:
    """``xml``: the first fitting attachment as text, without a byte order mark. ``attachments``: (name, content)."""
    first = F.get(F.filter("attachments", lambda a: is_invoice_attachment(a["name"])), F.lit(0))
    return df.withColumn("xml", F.regexp_replace(F.decode(first["content"], "UTF-8"), "^﻿", ""))


def read_layout(df: DataFrame, json: str = "layout_json") -> DataFrame:
    """``df`` with page_count, lines, tables and error from layout JSON."""
    mapped = df.withColumn("_layout", map_layout(F.from_json(json, LAYOUT)))
    return mapped.withColumns({n: F.col("_layout")[n] for n in ("page_count", "lines", "tables", "error")}).drop("_layout")


def read_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """``df`` with what a vision model said: is_invoice, invoice (canonical) and markdown, and whether the text was no
    JSON, in which case a port asks once more."""
    shape = f"struct<is_invoice:boolean,invoice:{CANONICAL},markdown:string>"
    parsed = F.from_json(strip_fences(reply), shape, {"mode": "PERMISSIVE"})
    out = df.withColumn("_reply", parsed)
    bad = F.col("_reply").isNull() | F.col("_reply.is_invoice").isNull()
    return out.select(*df.columns, F.col("_reply.is_invoice").alias("is_invoice"), F.col("_reply.invoice").alias("reply_invoice"), F.col("_reply.markdown").alias("reply_markdown"), bad.alias("not_json"))


def table_port(spark: SparkSession, rows: DataFrame, key: str = "doc_id") -> Port:
    """A port whose answers stand in a table."""
    return lambda asked: asked.select(key).join(rows, key)


def retried(port: Port, key: str = "doc_id") -> Port:
    """A model port (to doc_id, reply) that is asked once more for replies that are no JSON."""

    def ask(asked: DataFrame) -> DataFrame:
        first = read_replies(port(asked))
        again = asked.join(first.where("not_json").select(key), key, "left_semi")
        return first.where("NOT not_json").unionByName(read_replies(port(again)))

    return ask


@dataclass
class Sinks:
    """Folders to which rows are appended as Parquet."""

    root: str
    names: tuple[str, ...] = field(default=("documents", "files", "events", "escalations"))

    def append(self, df: DataFrame, name: str) -> None:
        if name not in self.names:
            raise ValueError(f"no sink {name!r}")
        df.write.mode("append").parquet(f"{self.root}/{name}")


def events(df: DataFrame, name: str, **detail: Column) -> DataFrame:
    """Trace rows: doc_id, event, detail (JSON) and time."""
    body = F.to_json(F.struct(*[c.alias(k) for k, c in detail.items()])) if detail else F.lit("{}")
    return df.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(name).alias("event"), body.alias("detail"), F.current_timestamp().alias("at"))


def write_markdown(df: DataFrame, folder: str) -> None:
    df.where(F.col("markdown").isNotNull()).select("markdown").write.mode("append").text(folder, lineSep="\n\f\n")
