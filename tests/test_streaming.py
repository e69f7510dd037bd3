from pyspark.sql import functions as F

from sitewright.streaming import state

KIND = "user_id long, seq long, pose double"


def test_stream_is_folded_once(spark, tmp_path):
    source, table, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.createDataFrame([(1, 1, 0.5), (2, 2, 1.5), (1, 3, 2.5)], KIND).write.parquet(source)
    run = lambda: state.upserted(spark.readStream.schema(KIND).parquet(source), table, ["user_id"], ["seq"], str(tmp_path / "c"), lambda df: seen.append(df.count())).awaitTermination()
    run()
    spark.createDataFrame([(2, 9, 9.5), (3, 8, 8.5)], KIND).write.mode("append").parquet(source)
    run()
    run()
    last = state.current(spark, table, spark.read.parquet(source).schema)
    assert sorted(map(tuple, last.collect())) == [(1, 3, 2.5), (2, 9, 9.5), (3, 8, 8.5)] and seen == [2, 3]


def test_a_batch_rewrites_only_its_buckets_and_old_versions_go(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    def put(rows):
        spark.createDataFrame(rows, KIND).write.mode("append").parquet(source)
        state.upserted(spark.readStream.schema(KIND).parquet(source), table, ["user_id"], ["seq"], str(tmp_path / "c")).awaitTermination()
    put([(u, 1, 0.5) for u in range(40)])
    before = state._versions(spark, table)
    put([(7, 2, 1.5)])
    after = state._versions(spark, table)
    assert len(set(after) - set(before)) == 1
    put([(7, 3, 2.5)])
    put([(7, 1, 9.5)])
    last = {r.user_id: (r.seq, r.pose) for r in state.current(spark, table, spark.read.parquet(source).schema).collect()}
    assert last == {u: (1, 0.5) for u in range(40)} | {7: (3, 2.5)}
    bucket = {b for b, _ in set(after) - set(before)}
    assert len([v for b, v in state._versions(spark, table) if b in bucket]) == 2


def test_throttle_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, 0.01, 1), (1, 0.05, 2), (1, 0.07, 3), (1, 99.0, 4)], "user_id long, s double, id long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source).withWatermark("ts", "1 second")
    out = state.throttled(stream, ["user_id"], "ts", "66 milliseconds", ["id"])
    q = out.writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id for r in spark.table("throttled").collect()}
    # spans of 66 ms: 0 to 66 holds the first two, of which the newer counts; the last row only moves the watermark
    assert got == {2, 3} or got == {2, 3, 4}


def test_arrivals_and_steps(spark):
    rows = [("s", 1, 1, "drive"), ("s", 1, 2, "arrive"), ("s", 1, 3, "drive"), ("s", 0, 4, "arrive"), ("s", 2, 5, "reset"), ("s", 2, 6, "arrive")]
    assert [r.at for r in state.arrivals(spark.createDataFrame(rows, "scene_id string, seq_no int, at int, kind string")).collect()] == [2]
    lines = spark.createDataFrame([("step 120 loss 0.031",), ("hello",)], "value string")
    assert [tuple(r) for r in state.training_steps(lines).collect()] == [(120, 0.031)]
