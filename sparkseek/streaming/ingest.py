"""Streams of changes into a collection, and epochs as versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import EPOCH_SECONDS, CollectionStore


def into_collection(stream: DataFrame, target: CollectionStore, checkpoint: str, once: bool = False, every: str | None = None) -> StreamingQuery:
    """Appends a stream of changes (id, ..., op, seq) to a collection, a version a micro-batch.

    A batch that is replayed after a failure finds the version of its number and isn't written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"{checkpoint}#{batch_id}"
        if target.versions().where(F.col("source_id") == name).limit(1).count() or batch.isEmpty():
            return
        target.append(batch, "implicit", name)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def epochs(changes: DataFrame, ts_col: str = "ts", op: str = "op", seconds: int = EPOCH_SECONDS, late: str | None = None) -> DataFrame:
    """(epoch, records_upserted, records_deleted, total_operations) by tumbling window of arrival.

    For streams, late is how long changes may be overdue; without it windows stay open in state.
    """
    if changes.isStreaming and late:
        changes = changes.withWatermark(ts_col, late)
    window = F.window(F.col(ts_col), f"{seconds} seconds")
    deleted = F.col(op) == "delete"
    sums = changes.groupBy(window.alias("w")).agg(F.count(F.when(~deleted, 1)).alias("records_upserted"), F.count(F.when(deleted, 1)).alias("records_deleted"), F.count("*").alias("total_operations"))
    return sums.select(F.col("w.start").alias("epoch"), "records_upserted", "records_deleted", "total_operations")


def sessions(changes: DataFrame, key: str, ts_col: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, start, end, operations): runs of a key's changes with less than gap between them."""
    if changes.isStreaming and late:
        changes = changes.withWatermark(ts_col, late)
    w = F.session_window(F.col(ts_col), gap)
    return changes.groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("operations")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "operations")


def latest_per_key(changes: DataFrame) -> DataFrame:
    """(id, seq, op, live): a running latest state of a stream of (id, seq, op); a row each time a key's state changes."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, op = state.get if state.exists else (None, None)
        before = seq
        for b in batches:
            if len(b):
                last = b.loc[b["seq"].idxmax()]
                if seq is None or last["seq"] > seq:
                    seq, op = int(last["seq"]), str(last["op"])
        if seq != before:
            state.update((seq, op))
            yield pd.DataFrame({"id": [key[0]], "seq": [seq], "op": [op], "live": [op != "delete"]})

    kind = changes.schema["id"].dataType.simpleString()
    return changes.select("id", F.col("seq").cast("bigint").alias("seq"), "op").groupBy("id").applyInPandasWithState(update, f"id {kind}, seq bigint, op string, live boolean", "seq bigint, op string", "update", GroupStateTimeout.NoTimeout)
