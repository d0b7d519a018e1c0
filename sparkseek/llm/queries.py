"""The operators as queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, line_dedup, lm_scoring, mixing, pii, quality, simhash, substring_dedup, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.withColumn("kept", F.col("quality_score") >= quality.REJECT_BELOW)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identifiers(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "source"])


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, queries=vectors.where(F.col("vec_id") % topk.QUERY_EVERY == 0))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_classifier, op3_lm_scoring, op4_byte_bpe, op5_pii, op6_exact_dedup, op7_soft_mixing, op8_exact_top_k, op9_line_dedup, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.SQL, "op8_exact_top_k": topk.SQL, "op9_line_dedup": line_dedup.SQL}
