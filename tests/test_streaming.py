"""Streams over files give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.streaming import streams


def feed(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return events, streams.arriving(spark, str(tmp_path / "in"), events.schema)


def test_scoring(spark, sf_dir, tmp_path):
    events, stream = feed(spark, sf_dir, tmp_path)
    score = lambda df: df.select("event_id", (F.col("value") * 2).alias("s"))
    q = streams.scored(stream, score).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, score(events).collect()))


def test_hourly_counts(spark, sf_dir, tmp_path):
    events, stream = feed(spark, sf_dir, tmp_path)
    q = streams.hourly_counts(stream, "ts", ["event_type"], "1000 days").writeStream.outputMode("append").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").count() == 0  # nothing is final before the watermark
    q = streams.hourly_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("all_hours").start()
    q.processAllAvailable()
    q.stop()
    expected = events.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).count()
    assert sorted(map(tuple, spark.table("all_hours").collect())) == sorted(map(tuple, expected.collect()))


def test_alerts(spark, sf_dir, tmp_path):
    _, stream = feed(spark, sf_dir, tmp_path)
    got = []
    q = streams.top_alerts(stream, [F.desc("value"), F.col("event_id")], 5, lambda rows, n: got.append((n, rows.count()))).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [(0, 5), (1, 5), (2, 5)]


def test_a_batch_that_runs_again_is_kept_once(spark, tmp_path):
    save, path = streams.batch_writer(str(tmp_path / "alerts")), str(tmp_path / "alerts")
    save(spark.range(5), 0)
    save(spark.range(5, 8), 1)
    save(spark.range(5, 8), 1)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(8))
