"""Confidence and integrity: summaries, low-confidence rows and clusters, reference checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.operators.islands import islands, previous


def nth(values: Column, index: Column) -> Column:
    """An element of a sorted array, counted from 0."""
    return F.element_at(values, (index + 1).cast("int"))


def floor_rank(n: Column, percent: int, less: int = 0) -> Column:
    """floor(percent / 100 * (n - less)), in whole numbers."""
    return F.floor((n - less) * percent / 100)


def confidence_summary(df: DataFrame, column: str = "conf", key: str = "doc_id") -> DataFrame:
    """n, avg, min, max, p05 and p95 (index floor(p * (n - 1)) of the sorted values), of hundredths, as ratios."""
    g = df.where(F.col(column).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(column).alias("s"), F.array_sort(F.collect_list(column)).alias("v"))
    n = F.col("n")
    return g.select(key, "n", (F.col("s") / (n * 100)).alias("avg_conf"), (nth(F.col("v"), F.lit(0)) / 100).alias("min_conf"), (nth(F.col("v"), n - 1) / 100).alias("max_conf"), (nth(F.col("v"), floor_rank(n, 5, 1)) / 100).alias("p05"), (nth(F.col("v"), floor_rank(n, 95, 1)) / 100).alias("p95"))


def clusters(words: DataFrame, below: int, gap_ms: int = 200, least: int = 3) -> DataFrame:
    """Runs of low words in one segment with small gaps: doc_id, idx, w0, w1, n, sum of p."""
    low = words.where(F.col("p") < below)
    same = F.col("w0") - previous("w1", "w0", ("doc_id", "idx")) <= gap_ms
    runs = islands(low, same, "w0", ("doc_id", "idx"))
    return runs.groupBy("doc_id", "idx", "island").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.count("*").alias("n"), F.sum("p").alias("p")).where(F.col("n") >= least).drop("island")


def thousandths(c: Column) -> Column:
    """A whole number of thousandths as text with three digits."""
    return F.concat(F.floor(c / 1000).cast("string"), F.lit("."), F.lpad((c % 1000).cast("string"), 3, "0"))


def low_confidence_rows(words: DataFrame, below: int) -> DataFrame:
    """Low words, then their clusters as rows named [cluster] with the mean score, cut to three digits."""
    low = words.where(F.col("p") < below).select("doc_id", "idx", "word", "w0", "w1", thousandths(F.col("p") * 10).alias("score"))
    runs = clusters(words, below).select("doc_id", "idx", F.lit("[cluster]").alias("word"), "w0", "w1", thousandths(F.floor(F.col("p") * 10 / F.col("n"))).alias("score"))
    return low.unionByName(runs)


def mean_hundredths(words: Column) -> Column:
    """The mean of ``p`` over an array of words, as a ratio; null for none."""
    total = F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + w["p"])
    return F.when(F.size(words) > 0, total / (F.size(words) * 100))


def logprob_confidence(logprob: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (logprob + 5) / 5.0))


def review_queue(sentences: DataFrame, mean_below: int = 30, p05_below: int = 10, per_chunk: int = 4) -> DataFrame:
    """Sentences of low mean or low p05, and chunks of which a quarter or more are low; from (doc_id, idx, conf, p05)."""
    low = F.col("conf") < mean_below
    rows = sentences.where(low | (F.col("p05") < p05_below)).select("doc_id", "idx", F.lit("sentence").alias("source"), F.when(low, "low_mean").otherwise("p05_drop").alias("reason"), (F.col("conf") / 100).alias("score"), (F.col("p05") / 100).alias("p05"))
    chunk = F.floor(F.col("idx") / per_chunk).alias("chunk")
    g = sentences.groupBy("doc_id", chunk).agg(F.min("idx").alias("idx"), F.sum("conf").alias("s"), F.count("*").alias("n"), F.min("p05").alias("p"), F.count_if(low).alias("k")).where("k * 4 >= n")
    return rows.unionByName(g.select("doc_id", "idx", F.lit("chunk").alias("source"), F.lit("low_span").alias("reason"), (F.col("s") / (F.col("n") * 100)).alias("score"), (F.col("p") / 100).alias("p05")))


def speaker_histogram(df: DataFrame, group: str) -> DataFrame:
    """(doc_id, group, histogram, majority): rows per speaker as text, and the speaker of most rows, the first of equals."""
    g = df.groupBy("doc_id", group, "speaker").agg(F.count("*").alias("k"), F.min("idx").alias("f"))
    pairs = F.array_sort(F.collect_list(F.struct("speaker", "k")))
    text = F.array_join(F.transform(pairs, lambda x: F.concat(x["speaker"], F.lit("="), x["k"].cast("string"))), ",")
    return g.groupBy("doc_id", group).agg(text.alias("histogram"), F.max_by("speaker", F.struct("k", -F.col("f"))).alias("majority"))


def chunk_metrics(df: DataFrame, low_below: int = 45) -> DataFrame:
    """Token total, speaker switches, majority and histogram, token-weighted mean, p05 (index floor(n * 0.05)) and share of low rows, per chunk."""
    marked = df.withColumn("__switch", F.when(previous("speaker", "idx", ("doc_id", "chunk")) != F.col("speaker"), 1).otherwise(0))
    g = marked.groupBy("doc_id", "chunk").agg(F.sum("tokens").alias("tokens"), F.sum("__switch").alias("switches"), F.sum(F.col("tokens") * F.col("conf")).alias("ws"), F.array_sort(F.collect_list("conf")).alias("v"), F.count("*").alias("n"), F.count_if(F.col("conf") < low_below).alias("low"))
    n = F.col("n")
    out = g.join(speaker_histogram(df, "chunk"), ["doc_id", "chunk"])
    return out.select("doc_id", "chunk", "tokens", "switches", "majority", "histogram", (F.col("ws") / (F.col("tokens") * 100)).alias("weighted_mean"), (nth(F.col("v"), floor_rank(n, 5)) / 100).alias("p05"), (F.col("low") / n).alias("low_ratio"))


def sparkline(levels: DataFrame, blocks: str) -> DataFrame:
    """(doc_id, sparkline): a block for each section's level, a dot for none."""
    sign = F.when(F.col("level").isNull(), ".").otherwise(F.substr(F.lit(blocks), (F.col("level") + 1).cast("int"), F.lit(1)))
    rows = levels.select("doc_id", "section", sign.alias("s"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "s"))), lambda x: x["s"]), "").alias("sparkline"))
