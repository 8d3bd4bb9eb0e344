"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies meet in three stages, each comparing the whole normalised text beside its digest:

1. *local*: the map-side half of the first aggregation merges the copies inside one input partition;
2. *salted*: a digest group is dealt over ``salts`` tasks by the partition its rows come from;
3. *global*: at most ``salts`` winners of a group meet.

A group that holds a third of all rows therefore costs each task no more than one row per input partition. The way back
is as safe: the verdict of a group goes to each salt of its documents' ids, and rows join it by digest and salt.

Defined cases: a null text counts as empty; all empty texts form one group; rows that repeat a ``doc_id`` with an
equal text are one document, and all of them are ``kept`` where it is; a null ``doc_id`` loses to any other, and a group
of null ids alone keeps them as one; a very long text goes whole through every stage, one row at a time; an empty table
gives an empty result. Columns of the input other than the id and the text are neither read nor in the way, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, norm, digest and check, a second hash that guards the join back against a shared digest."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("norm"))
    return rows.withColumns({"digest": F.sha2("norm", 256), "check": F.xxhash64("norm")})


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: digest, check, keep_id, group_size, and the salts of its ids. Repeated rows
    count each."""
    salted = _keyed(docs, id_col, text_col).withColumns({"part": F.spark_partition_id() % salts, "salt": scratch.salt("doc_id")})
    parts = salted.groupBy("digest", "check", "norm", "part").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), scratch.salts(F.col("salt")))
    whole = parts.groupBy("digest", "check", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or("salts").alias("salts"))
    return whole.select("digest", "check", "keep_id", "group_size", "salts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Every document's verdict: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _keyed(docs, id_col, text_col).select("doc_id", "digest", "check", scratch.salt("doc_id").alias("salt"))
    verdicts = winners(docs, id_col, text_col, salts).select("digest", "check", "keep_id", "group_size", scratch.each_salt())
    return rows.join(verdicts, ["digest", "check", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were. The rows themselves go through the
    three stages, so that no join has to find them again."""
    norm = normalised(F.col(f"`{text_col}`"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    by_id = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"))
    rows = docs.select(norm.alias("norm"), F.sha2(norm, 256).alias("digest"), by_id.alias("by"), row.alias("row"))
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    least = F.min_by("row", "by").alias("row"), F.min("by").alias("by")
    parts = salted.groupBy("digest", "norm", "salt").agg(*least)
    return parts.groupBy("digest", "norm").agg(least[0]).select("row.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
