"""A corpus pipeline over ``documents``: quality, exact copies, near copies, the mix of sources, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes what a stage returns to the folder that driver and executors share and reads it
again as the next one's ``docs``. A document that the mix takes twice is two rows from there on.

Defined cases, for all stages: an empty table gives an empty result. Extra columns, whatever their names, go along with
their row up to the mix; packing returns its own. Very long texts are read whole, in slices. Each stage's docstring
names what it does with null and empty texts, null and repeated ids, and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.llm import exact_dedup, mixing, packing, quality, queries, scratch, shingle_join


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more, 0.5 itself included. Null and empty texts have the score of the
    bias alone; every row is scored by its own text, whatever its id, and a null id is never learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, "quality", quality.remainder(F.col("doc_id")) != 1)
    return quality.drop_low(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of least id, of equal texts; null ids come last, null and empty texts are one group, and of rows that
    are equal in id and text one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies; null ids come last, and of one id the text with the
    least hash. Texts without words stay. A similarity of 0.8 exactly is a link."""
    return shingle_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the sources' target weights; a document is as many rows as it is taken times. Texts without words, null
    ones among them, are never taken; null sources are one; rows of one id, or of null ids, share a key and are taken
    alike."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens. A null or empty text is its end id alone; every row is a
    document of its own, whatever its id."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
