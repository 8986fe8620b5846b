"""What has to be done again: state joins and anti joins before any work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(manifest: DataFrame, state: DataFrame, most_retries: int) -> DataFrame:
    """(id, status) of what isn't done: without a state, pending, running, or failed with retries left."""
    joined = manifest.join(state, "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return joined.where(F.col("status").isin("pending", "running") | (F.col("status") == "failed") & (F.col("retries") < most_retries)).select("id", "status")


def changed(now: DataFrame, done: DataFrame) -> DataFrame:
    """Documents whose hash isn't the one that was processed last."""
    return now.join(done, ["doc_id", "hash"], "left_anti")


def unstamped(docs: DataFrame, stamps: DataFrame) -> DataFrame:
    return docs.join(stamps, ["doc_id", "source", "sha"], "left_anti")


def latest_state(log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last value that isn't null of each column: partial updates of an append-only log, applied in order."""
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
