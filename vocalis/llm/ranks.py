"""Exact ranks inside groups by a distributed range sort; DataFrame operations only.

Rows are range-sorted by their group's hash and their order, so that a large group spreads over as many ranges as its rows fill.
Each range counts its own part of each group, the parts' counts give the ranges' offsets, and a row's rank is its range's offset
and its place inside. No task holds a group, and nothing but Spark's fixed-size sample of the sort keys reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalis.llm.frames import shuffle_partitions, stored, unused


def placed(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with what stands before each row in its group: ``position`` rows of ``rows``, and ``before`` of ``total`` weight.

    Keys and weights must not be null; nulls in ``order`` come first. Rows that are equal in ``order`` get different positions.
    Without a weight each row weighs 1. The columns range, position, rows, before and total are added.
    """
    sign = unused(df, "sign")
    # two groups with one hash may share a range, but each keeps its own order over the ranges
    dealt = df.withColumn(sign, F.xxhash64(*keys)).repartitionByRange(ranges or shuffle_partitions(df.sparkSession), sign, *order)
    dealt = stored(dealt.drop(sign).withColumn("range", F.spark_partition_id()))  # ranges are drawn once: a second draw could cut elsewhere
    w = F.col(weight) if weight else F.lit(1).cast("long")
    parts = dealt.groupBy("range", *keys).agg(F.count("*").alias("n"), F.sum(w).alias("w"))
    group, earlier = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("range", *keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.sum("n").over(group).alias("rows"), F.sum("w").over(group).alias("total"))
    inside = W.partitionBy("range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumns({"position": F.row_number().over(W.partitionBy("range", *keys).orderBy(*order)).cast("long") - 1, "before": F.coalesce(F.sum(w).over(inside), F.lit(0))})
    out = local.join(offsets.hint("merge"), ["range", *keys])
    return out.select(*df.columns, "range", (F.col("n0") + F.col("position")).alias("position"), "rows", (F.col("w0") + F.col("before")).alias("before"), "total")
