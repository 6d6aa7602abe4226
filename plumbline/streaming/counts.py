"""Counts by time over a stream, and resumable processing of files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """(keys, start, end, value): rows in each window; those later than `late` behind the newest are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need an instant
    counted = timed.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("value"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now as Parquet and stop; a later run with the same checkpoint takes only what is new."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
