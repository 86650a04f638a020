"""Streaming operators give what their batch forms give."""

import json

from pyspark.sql import functions as F

from siltmark.operators import search
from siltmark.streaming import logs as streaming


def run(query, name):
    query.processAllAvailable()
    query.stop()


def test_ordered_delivery(spark, tmp_path):
    packets = [(1, 0, "a"), (1, 2, "c"), (2, 1, "y"), (1, 1, "b"), (1, 1, "b"), (2, 0, "x"), (3, 5, "z")]
    for i, (s, q, p) in enumerate(packets):
        (tmp_path / f"{i:03}.json").write_text(json.dumps({"src": s, "seq": q, "payload": p}))
    source = spark.readStream.schema("src bigint, seq bigint, payload string").option("maxFilesPerTrigger", 2).json(str(tmp_path))
    # a processing-time timeout asks for another batch for ever, so that processAllAvailable() would not return
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        query = streaming.delivered(source).writeStream.format("memory").queryName("delivered").outputMode("append").start()
        run(query, "delivered")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    out = spark.table("delivered").where("status = 'delivered'").collect()
    assert sorted((r.src, r.seq, r.payload) for r in out) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x"), (2, 1, "y")]


def test_windows_and_index(spark):
    source = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events*.parquet")
    query = streaming.windowed_counts(source, "1 day", "1 day", "1 hour").writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    run(query, "windowed")
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = batch.groupBy(F.to_date("ts").alias("d"), "event_type").count()
    got = spark.table("windowed").select(F.to_date("w.start").alias("d"), "event_type", F.col("n").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    as_logs = lambda df: df.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("level"), F.lit("s").alias("source"), F.col("props").alias("message"))
    query = streaming.index_increment(as_logs(source)).writeStream.format("memory").queryName("postings").outputMode("append").start()
    run(query, "postings")
    assert sorted(map(tuple, spark.table("postings").collect())) == sorted(map(tuple, search.postings(as_logs(batch)).collect()))
