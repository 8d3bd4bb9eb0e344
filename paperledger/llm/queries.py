"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, mixing, packing, pii, quality, secret_scan, shingle_join, url_filter, vector_topk


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rest = quality.remainder(F.col("doc_id"))
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), "quality", rest != 1)
    held_out, predicted = F.coalesce(rest == 1, F.lit(False)), (F.col("score") >= 0.5).cast("int")
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_read(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "removed")


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_components(_read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_read(spark, sf_dir, "documents")))


def op9_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return vector_topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_pii, op3_mixing, op4_url_filter, op5_exact_dedup, op6_line_dedup, op7_shingle_join, op8_secret_scan, op9_vector_topk, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": url_filter.oracle(), "op5_exact_dedup": exact_dedup.ORACLE, "op9_vector_topk": vector_topk.ORACLE}
