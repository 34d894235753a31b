"""Structured Streaming forms of the event and job features (STM-1..5).

Watermarks and session windows have no counterpart in the reference; they bound the state here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def events(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """STM-1: event files as they arrive; event times in the session's zone."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def event_counts(stream: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """STM-2: counts by event type and hour; state of hours that are past the watermark is let go."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def once_each(stream: DataFrame, request_id: str, late: str = "1 day") -> DataFrame:
    """STM-5: each request id once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([request_id])


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """STM-6: sessions of each user, closed by a gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def drained(frame: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and return what it has given (small results; used by tests)."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def appended_once(stream: DataFrame, request_id: str, sink: str, checkpoint: str, late: str = "1 day") -> None:
    """STM-1, STM-5: append each request of what there is now once, to Parquet files.

    The checkpoint knows which files were read and which requests were seen; the sink's own log knows which files are
    part of it. So a run that was stopped goes on without loss or repetition.
    """
    once_each(stream, request_id, late).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
