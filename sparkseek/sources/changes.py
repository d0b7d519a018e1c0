"""The change log as a DataFrame: latest view, reads as of a version, and counts of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELETE = "delete"


def latest(changes: DataFrame, key: str = "id", version: str = "version", seq: str = "seq", op: str = "op") -> DataFrame:
    """The last change of each key, if it isn't a deletion.

    One aggregation, combined before the shuffle: keys of many changes move one row a partition.
    """
    row = F.struct(*changes.columns)
    last = changes.groupBy(key).agg(F.max_by(row, F.struct(version, seq)).alias("last"))
    return last.select("last.*").where(F.col(op) != DELETE)


def as_of(changes: DataFrame, version_no: int, version: str = "version", **names) -> DataFrame:
    """The latest view when version_no was the current one."""
    return latest(changes.where(F.col(version) <= version_no), version=version, **names)


def version_counts(changes: DataFrame, version: str = "version", op: str = "op") -> DataFrame:
    """(version, records_upserted, records_deleted, total_operations, cumulative_upserts).

    The running sum is over versions, a row each, and not over changes.
    """
    deleted = F.col(op) == DELETE
    each = changes.groupBy(version).agg(F.count(F.when(~deleted, 1)).alias("records_upserted"), F.count(F.when(deleted, 1)).alias("records_deleted"), F.count("*").alias("total_operations"))
    return each.withColumn("cumulative_upserts", F.sum("records_upserted").over(Window.orderBy(version).rowsBetween(Window.unboundedPreceding, 0)))


def versions_after(versions: DataFrame, version_no: int) -> DataFrame:
    return versions.where(F.col("version") > version_no)


def inverse(changes: DataFrame, version_no: int, key: str = "id", version: str = "version", seq: str = "seq", op: str = "op") -> DataFrame:
    """Changes that lead back to version_no: deletions of keys made since, and the old state of keys changed since."""
    since = changes.where(F.col(version) > version_no).select(key).distinct()
    before = as_of(changes, version_no, version=version, key=key, seq=seq, op=op)
    back = since.join(before, key, "left")
    return back.withColumn(op, F.when(F.col(version).isNull(), F.lit(DELETE)).otherwise(F.lit("upsert"))).drop(version, seq)
