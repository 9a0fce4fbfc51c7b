"""Streaming forms of event queries. Late rows beyond the watermark are dropped, as Spark does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Events as their files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark; a time without zone is taken in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, delay: str = "1 hour", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by tumbling or sliding window; works on streams and tables alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    marked = timed(events, delay)
    return marked.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def user_sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of users, which end after a gap without events."""
    marked = timed(events, delay)
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeat comes within the delay."""
    return timed(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def terminal_failures(log: DataFrame, unit: str, order: str, status: str, failed: str = "failed") -> DataFrame:
    """Units of an ordered log whose last event failed, with that event's number."""
    last = log.groupBy(unit).agg(F.max_by(status, order).alias("status"), F.max(order).alias("last"))
    return last.filter(F.col("status") == failed).select(unit, "last")
