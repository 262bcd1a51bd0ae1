from pyspark.sql import functions as F

from codeloom.streaming import incremental as streams


def test_activity_drops_nothing_in_time(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    got = {(r.start.hour, r.event_type): (r.n, r.total) for r in streams.activity(df).collect()}
    assert got == {(0, "a"): (2, 3.0), (1, "b"): (1, 4.0)}


def test_last_states(spark, tmp_path):
    feed = tmp_path / "feed"
    spark.createDataFrame([("a", 1, False), ("a", 3, True), ("b", 1, False)], "uid string, at long, deleted boolean").coalesce(1).write.parquet(f"{feed}/one")
    updates = spark.readStream.schema("uid string, at long, deleted boolean").parquet(f"{feed}/*")

    def run():
        q = streams.last_states(updates).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert {(r.uid, r.kept) for r in spark.read.parquet(f"{tmp_path}/out/0").collect()} == {("a", False), ("b", True)}
    spark.createDataFrame([("a", 2, False), ("b", 5, True)], "uid string, at long, deleted boolean").coalesce(1).write.parquet(f"{feed}/two")
    run()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name))
    assert {(r.uid, r.kept, r.at) for r in spark.read.parquet(str(last)).collect()} == {("a", False, 3), ("b", False, 5)}
