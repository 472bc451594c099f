"""Streams over the events: each query runs what has arrived and reads the resulting table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query
from plumbline.session import shared_folder
from plumbline.streaming import streams


def arriving(t):
    """The events' files as a stream; the folder holds other tables too, so they are picked by name."""
    schema = t.events.schema
    reader = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


@query("str1_continuous_scoring", "STR-1", "SELECT event_id, round(0.3 * value + hour(ts), 6)::DOUBLE AS score FROM events")
def _(t):
    score = lambda df: df.select("event_id", F.round(F.lit(0.3) * F.col("value") + F.hour("ts"), 6).alias("score"))
    return streams.collected(streams.scored(arriving(t), score), t.spark, shared_folder(t.spark))


@query("str2_hourly_counts", "STR-2", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def _(t):
    counts = streams.hourly_counts(arriving(t), "ts", ["event_type"])
    out = streams.collected(counts, t.spark, shared_folder(t.spark))
    return out.select("event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


@query("str3_alert_queue", "STR-3", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def _(t):
    path = f"{shared_folder(t.spark)}/alerts-{streams.uuid.uuid4().hex}"
    writer = streams.top_alerts(arriving(t).select("event_id", "value"), [F.desc("value"), F.col("event_id")], 25, streams.batch_writer(path))
    writer.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "value")
