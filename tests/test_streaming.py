"""Streaming forms against the batch rules, on a folder of files."""

from pyspark.sql import functions as F

from quillspark.operators import state
from quillspark.streaming import state as streaming

SCHEMA = "user_id long, event_id long, event_type string, s long"


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streams_equal_batch(spark, tmp_path):
    rows = [(u, u * 1000 + i, f"t{i % 3}", 1_000_000 + i * i * 7 + u) for u in range(5) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/log")
    batch = spark.read.parquet(f"{tmp_path}/log").withColumn("ts", F.timestamp_seconds("s"))
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/log").withColumn("ts", F.timestamp_seconds("s"))
    want = sorted(map(tuple, state.rate_limit(batch, "user_id", "ts", "event_id", 3, 600).collect()))
    assert sorted(map(tuple, drain(streaming.rate_limit_stream(stream, "user_id", "ts", "event_id", 3, 600), "limits"))) == want
    hours = drain(streaming.activity_stream(stream, "event_type", "ts"), "hours", "complete")
    whole = batch.groupBy(F.window("ts", "1 hour").start.alias("start"), F.col("event_type").alias("word")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert set(map(tuple, hours)) == set(map(tuple, whole))
    sessions = drain(streaming.session_stream(stream, "user_id", "ts", 900, "1 second"), "sessions", "complete")
    own = state.sessions(batch, "user_id", "ts", "event_id", 900).groupBy("user_id", "session_no").count().collect()
    assert sorted((r.key, r.n) for r in sessions) == sorted((r.user_id, r["count"]) for r in own)
