from pyspark.sql import functions as F

from stratalith.streaming import runs


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = runs.windowed_counts(runs.read(spark, f"{tmp_path}/in", "event_id long, ts timestamp, user_id long, event_type string, value double, props string"), "ts", "event_type", "1 day", "400 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("counts").collect()}
    want = {(r["start"], r["event_type"], r["n"]) for r in batch.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want and got
