"""Structured Streaming: log tail, sliding windows of results, and upserts of window states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as they come."""
    return spark.readStream.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def windowed(stream: DataFrame, length: str = "75 seconds", hop: str = "67 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts and mean value per sliding window of a stream with ts and value; later rows than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, hop)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(stream: DataFrame, gap: str = "200 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Runs of rows of one document with small gaps."""
    return stream.withWatermark("ts", late).groupBy("doc_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
