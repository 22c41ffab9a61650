"""Streaming forms of the stateless scans and of merging and deduplicating spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def merged(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Gap merge: rows of a key and type less than ``gap`` apart become one."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id", "event_type")
    return w.agg(F.count("*").alias("parts"), F.sum("value").alias("value")).select("user_id", "event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "parts", "value")


def once(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def windows(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and means in sliding windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("event_type", F.col("w.start").alias("start"), "n", "mean")
