"""Hybrid search: rankings of several searches fused by reciprocal rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SearchError

RRF_K = 60.0
EPSILON = 1.1920928955078125e-07
#: Results that each leg fetches for each one wanted.
FETCH = 3
DIGITS = 9


def fuse(legs: list[DataFrame], k: int = 10, rrf_k: float = RRF_K, truncate: bool = True) -> DataFrame:
    """(query_id, rank, id, score): ids by the sum over legs of 1 / (rank from 0 + rrf_k + epsilon).

    A leg has (query_id, rank, id), rank from 1. Without truncate all ids of all legs come back, as many as they are.
    """
    if len(legs) < 2:
        raise SearchError("two rankings at least are fused")
    every = reduce(DataFrame.unionByName, [leg.select("query_id", F.col("rank").cast("double").alias("rank"), "id") for leg in legs])
    share = F.lit(1.0) / (F.col("rank") - 1.0 + F.lit(rrf_k) + F.lit(EPSILON))
    sums = every.groupBy("query_id", "id").agg(F.round(F.sum(share), DIGITS).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = sums.withColumn("rank", F.row_number().over(by)).select("query_id", "rank", "id", "score")
    return ranked.where(F.col("rank") <= k) if truncate else ranked


def as_leg(hits: DataFrame, query_id: int = 0, larger_is_better: bool = True) -> DataFrame:
    """A ranking (query_id, rank, id, score) from one query's hits (id, score)."""
    order = F.desc("score") if larger_is_better else F.asc("score")
    return hits.select(F.lit(query_id).cast("bigint").alias("query_id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "id")).alias("rank"), "id", "score")
