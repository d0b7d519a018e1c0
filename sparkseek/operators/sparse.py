"""Sparse top-k search over postings (dim, id, val), exact or quantised with early termination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SearchError
from ..functions.quantize import sparse_code

DIGITS = 6
OVERSAMPLE = 5


def postings(records: DataFrame, id_col: str = "id", sparse_col: str = "sparse") -> DataFrame:
    """(dim, id, val) of records whose sparse column is an array of (dim, val)."""
    return records.select(F.col(id_col).alias("id"), F.explode(sparse_col).alias("e")).select("e.dim", "id", "e.val")


def with_codes(table: DataFrame, upper: float | Column, bits: int) -> DataFrame:
    """Postings with the column code."""
    return table.withColumn("code", sparse_code(F.col("val"), upper, bits))


def query_table(spark, terms: list[tuple], query_id: int = 0, dim_type: str = "bigint") -> DataFrame:
    """(query_id, dim, q) of one query."""
    return spark.createDataFrame([(query_id, d, float(v)) for d, v in terms], f"query_id bigint, dim {dim_type}, q double")


def top_per_query(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """(query_id, rank, id, score): the k best of each query, ties to the smallest id."""
    by = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", score)


def search(table: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k largest sparse products for each query of (query_id, dim, q)."""
    product = F.sum(F.col("q").cast("double") * F.col("val").cast("double"))
    scores = table.join(queries, "dim").groupBy("query_id", "id").agg(F.round(product, DIGITS).alias("score"))
    return top_per_query(scores, k)


def quantized_scores(table: DataFrame, queries: DataFrame, upper: float, bits: int, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score): integer products of codes. table has code; a query's own threshold column counts first.

    A term whose code is at most trunc(threshold * 2^bits) reads only postings of codes from trunc(min(threshold *
    2^bits, 255)) on. Ids whose products are all 0 are scored 0.
    """
    q = queries.withColumn("q_code", sparse_code(F.col("q"), upper, bits).cast("bigint"))
    limit = F.col("threshold") if "threshold" in queries.columns else F.lit(threshold).cast("double")
    if "threshold" in queries.columns and threshold is not None:
        limit = F.coalesce(limit, F.lit(threshold))
    q = q.withColumn("cut", F.when(limit.isNull() | (F.col("q_code") > F.floor(limit * F.lit(float(1 << bits)))), F.lit(0)).otherwise(F.floor(F.least(limit * F.lit(float(1 << bits)), F.lit(255.0)))))
    read = table.join(q.select("query_id", "dim", "q_code", "cut"), (table["dim"] == q["dim"]) & (table["code"] >= q["cut"]))
    return read.groupBy("query_id", "id").agg(F.sum(F.col("q_code") * F.col("code")).alias("score"))


def _within_reach(table: DataFrame, queries: DataFrame, k: int, upper: float, bits: int) -> DataFrame:
    """(query_id, id) of all whose product can reach the k-th best, by what the codes leave open.

    A code says between which steps a value lies; at the ends, where values are clipped, that is the least or the
    largest value of the dimension. The k-th largest of the lower bounds is reached by k products at least, so an id
    whose upper bound is less isn't among the k best.
    """
    top, step = (1 << bits) - 1, upper / ((1 << bits) - 1)
    value, q = F.col("val").cast("double"), F.col("q").cast("double")
    ends = table.join(queries.select("dim").distinct(), "dim", "left_semi").groupBy("dim").agg(F.min(value).alias("least"), F.max(value).alias("most"))
    low = F.when(F.col("code") == 0, F.least(F.col("least"), F.lit(0.0))).otherwise(F.col("code") * F.lit(step))
    high = F.when(F.col("code") == top, F.greatest(F.col("most"), F.lit(upper))).otherwise((F.col("code") + 1) * F.lit(step))
    both = table.join(queries.select("dim", "query_id", "q"), "dim").join(ends, "dim").select("query_id", "id", (q * low).alias("a"), (q * high).alias("b"))
    bounds = both.groupBy("query_id", "id").agg(F.sum(F.least("a", "b")).alias("low"), F.sum(F.greatest("a", "b")).alias("high"))
    by = Window.partitionBy("query_id").orderBy(F.desc("low"), "id")
    kth = bounds.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min("low").alias("kth"))
    # what rounding of scores and sums can move
    return bounds.join(kth, "query_id").where(F.col("high") >= F.col("kth") - F.lit(10.0**-DIGITS * 2) - F.abs("kth") * 1e-9).select("query_id", "id")


def quantized_search(table: DataFrame, queries: DataFrame, k: int = 10, upper: float = 1.0, bits: int = 6, threshold: float | None = None, rerank: bool = False, oversample: int | None = OVERSAMPLE) -> DataFrame:
    """(query_id, rank, id, score): the k best by quantised products; with rerank, oversample * k of them by exact ones.

    With oversample=None all that can be among the k best by exact products are re-ranked, whatever was clipped, so
    that the result is that of search(); postings that a threshold would leave out have no bound.
    """
    if bits < 1 or bits > 8:
        raise SearchError("codes have 1 to 8 bits")
    whole = rerank and oversample is None
    if whole and (threshold is not None or "threshold" in queries.columns):
        raise SearchError("a threshold needs an oversample")
    if not whole:
        scores = quantized_scores(table, queries, upper, bits, threshold)
    if not rerank:
        return top_per_query(scores, k)
    some = _within_reach(table, queries, k, upper, bits) if whole else top_per_query(scores, k * oversample).select("query_id", "id")
    exact = table.join(queries.select("query_id", "dim", "q"), "dim").join(some, ["query_id", "id"], "left_semi")
    product = F.sum(F.col("q").cast("double") * F.col("val").cast("double"))
    return top_per_query(exact.groupBy("query_id", "id").agg(F.round(product, DIGITS).alias("score")), k)
