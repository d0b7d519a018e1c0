"""Point reads over the latest view of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_id(records: DataFrame, record_id, id_col: str = "id") -> DataFrame:
    return records.where(F.col(id_col) == F.lit(record_id))


def by_document(records: DataFrame, document_id, document_col: str = "document_id") -> DataFrame:
    return records.where(F.col(document_col) == F.lit(document_id))


def exists(records: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """ids with the column present; rows of ids with a null id aren't present."""
    known = records.select(F.col(id_col).alias("known_id")).distinct()
    return ids.join(known, ids[id_col] == known["known_id"], "left").select(*[ids[c] for c in ids.columns], F.col("known_id").isNotNull().alias("present"))


def with_records(hits: DataFrame, records: DataFrame, cols: tuple[str, ...] = ("document_id",), text: bool = False, id_col: str = "id") -> DataFrame:
    """Hits with columns of their records; text is null unless it is asked for, and isn't read then."""
    wanted = [c for c in cols if c != "text"] + (["text"] if text else [])
    out = hits.join(records.select(F.col(id_col).alias("id"), *wanted), "id", "left")
    return out if text else out.withColumn("text", F.lit(None).cast("string"))
