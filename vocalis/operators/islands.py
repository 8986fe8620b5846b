"""Gaps and islands: runs of neighbouring rows, numbered by a running sum of breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def islands(df: DataFrame, same: Column, order: str = "idx", key: tuple[str, ...] = ("doc_id",), name: str = "island") -> DataFrame:
    """Numbers the runs from 1. ``same`` says whether a row goes on with the row before; null counts as no."""
    w = W.partitionBy(*key).orderBy(order)
    return df.withColumn("__break", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("__break").over(w)).drop("__break")


def previous(column: str, order: str = "idx", key: tuple[str, ...] = ("doc_id",)) -> Column:
    return F.lag(column).over(W.partitionBy(*key).orderBy(order))


def collapse(df: DataFrame, name: str = "island", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per run: first start, last end, speaker of the first row, text joined in order, number of rows."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return df.groupBy(*key, name).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min_by("speaker", "idx").alias("speaker"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n"))
