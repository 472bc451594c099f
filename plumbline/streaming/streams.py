"""Arriving rows: scoring, hourly counts after a watermark, and alerts per batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with a score each; any row-wise function of a batch works on a stream as it is."""
    return score(stream)


def hourly_counts(stream: DataFrame, ts: str, key: Sequence[str], late: str = "2 hours") -> DataFrame:
    """(key, hour, n): appended once the watermark has passed the hour; later rows are dropped."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counts = timed.groupBy(F.window("__ts", "1 hour"), *key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*key, F.col("window.start").alias("hour"), "n")


def top_alerts(stream: DataFrame, order: Sequence[Column], budget: int, write: Callable[[DataFrame, int], None]):
    """A writer that hands each batch's first ``budget`` rows along ``order`` to ``write(rows, batch)``."""
    return stream.writeStream.foreachBatch(lambda batch, number: write(batch.orderBy(*order).limit(budget), number))


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its number in place of what is there, so that a batch that is run again is kept once."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def collected(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Runs an appending stream over what has arrived so far into a new table of ``folder``, and reads it."""
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
