"""Structured Streaming over an event table: the same transformation serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Days before late data are given up: the freshness lag of the daily sources.
LATE = "3 days"


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """A stream of parquet files with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _stamped(events: DataFrame, late: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if events.isStreaming else e


def hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """``hour, event_type, n, total`` in tumbling windows of an hour."""
    g = _stamped(events, late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """``user_id, started, ended, n``: activity without a pause of ``gap``."""
    g = _stamped(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events once by id, with state bounded by the watermark."""
    e = _stamped(events, late)
    return e.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else e.dropDuplicates(["event_id"])


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; exactly-once by the checkpoint folder."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
