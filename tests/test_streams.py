from sparkseek.streaming import ingest


def changes(spark):
    rows = [("2024-01-01 00:10:00", "upsert"), ("2024-01-01 00:50:00", "delete"), ("2024-01-01 01:00:00", "upsert"), ("2024-01-01 03:30:00", "upsert")]
    return spark.createDataFrame([(1, t, op) for t, op in rows], "id int, t string, op string").selectExpr("id", "cast(t as timestamp) ts", "op")


def test_epochs_are_tumbling_windows(spark):
    got = sorted((r["epoch"].hour, r["records_upserted"], r["records_deleted"], r["total_operations"]) for r in ingest.epochs(changes(spark)).collect())
    assert got == [(0, 1, 1, 2), (1, 1, 0, 1), (3, 1, 0, 1)]


def test_sessions(spark):
    got = sorted((r["start"].hour, r["start"].minute, r["operations"]) for r in ingest.sessions(changes(spark), "id", gap="45 minutes").collect())
    assert got == [(0, 10, 3), (3, 30, 1)]


def test_late_changes_are_dropped_from_streams(spark, tmp_path):
    changes(spark).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id int, ts timestamp, op string").parquet(f"file://{tmp_path}/in")
    ingest.epochs(stream, late="1 hour").writeStream.format("memory").queryName("epochs").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    closed = sorted((r["epoch"].hour, r["total_operations"]) for r in spark.table("epochs").collect())
    assert closed == [(0, 2), (1, 1)], "the last window is still open"
