from lodestone.streaming import queue


def test_leases_fence_and_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("t", "claim", "a1", 1000), ("t", "result", "a0", 1500), ("t", "result", "a1", 2000), ("u", "claim", "b1", 1000)]
    late = [("v", "claim", "c1", 10_000_000)]
    for k, part in enumerate([rows, late]):
        df = spark.createDataFrame(part, "task_id string, kind string, attempt string, at long").selectExpr("*", "timestamp_millis(at) as time")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    schema = "task_id string, kind string, attempt string, at long, time timestamp"
    events = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("time", "1 second")
    q = queue.leases(events, 60_000).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.task_id, r.attempt, r.outcome) for r in spark.table("leases").collect())
    assert got == [("t", "a0", "stale"), ("t", "a1", "accepted"), ("u", "b1", "expired")]
