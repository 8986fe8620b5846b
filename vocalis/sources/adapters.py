"""The engine's frames, built from the test tables.

Order is explicit everywhere: a document's rows carry an ordinal. Times are whole milliseconds, confidences whole hundredths;
both become seconds and ratios only at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WORD_MS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id(doc: Column, ordinal: Column) -> Column:
    """A name for a row of a document: no two rows share one, whatever their numbers."""
    return F.concat_ws("-", doc.cast("string"), ordinal.cast("string"))


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+")).cast("long")


def _timed(df: DataFrame, order: str, step: Column) -> DataFrame:
    before = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("t0", F.coalesce(F.sum(step).over(before), F.lit(0)))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, speaker, text, words, t0, t1 (ms), conf (hundredths)."""
    c = table(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text", word_count(F.col("text")).alias("words"), ((F.col("conv_id") * 31 + F.col("turn") * 17) % 100).alias("conf"))
    s = _timed(s, "idx", F.col("words") * WORD_MS)
    return s.select("doc_id", "idx", "speaker", "text", "words", "t0", (F.col("t0") + F.col("words") * WORD_MS).alias("t1"), "conf")


def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, k, word, w0, w1 (ms), p (hundredths): the words of each segment, 400 ms each."""
    s = segments(spark, sf_dir)
    w = s.select("doc_id", "idx", "t0", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("k", "word"))
    k = F.col("k").cast("long")
    return w.select("doc_id", "idx", k.alias("k"), "word", (F.col("t0") + k * WORD_MS).alias("w0"), (F.col("t0") + (k + 1) * WORD_MS).alias("w1"), ((k * 37 + F.col("idx") * 11 + F.col("doc_id")) % 100).alias("p"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line: blank lines are kept."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, speaker, text, words, t0, t1: the lines that aren't blank, with pauses of 0 to 1.2 s after them."""
    u = lines(spark, sf_dir).where(F.trim("line") != "")
    u = u.select("doc_id", F.col("pos").alias("idx"), F.concat(F.lit("S"), (F.length("line") % 3).cast("string")).alias("speaker"), F.col("line").alias("text"), word_count(F.col("line")).alias("words"), ((F.length("line") % 7) * 200).cast("long").alias("gap"))
    u = _timed(u, "idx", F.col("words") * WORD_MS + F.col("gap"))
    return u.select("doc_id", "idx", "speaker", "text", "words", "t0", (F.col("t0") + F.col("words") * WORD_MS).alias("t1"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, turn, speaker, s0, s1: runs of one speaker."""
    u = utterances(spark, sf_dir)
    order = W.partitionBy("doc_id").orderBy("idx")
    u = u.withColumn("new", F.when(F.lag("speaker").over(order) == F.col("speaker"), 0).otherwise(1)).withColumn("turn", F.sum("new").over(order))
    return u.groupBy("doc_id", "turn").agg(F.min("speaker").alias("speaker"), F.min("t0").alias("s0"), F.max("t1").alias("s1"))


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, event_id, word, w0, w1 (ms), p (hundredths, at most 100)."""
    e = table(spark, sf_dir, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return e.select(F.col("user_id").alias("doc_id"), "event_id", F.col("event_type").alias("word"), ms.alias("w0"), (ms + 200).alias("w1"), F.least(F.lit(100), F.floor("value")).cast("long").alias("p"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc, action, status, created_ms, duration_ms: a job log from the event table."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 20, "pending").when(F.col("value") < 60, "running").when(F.col("value") < 160, "succeeded").otherwise("failed")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("doc"), F.col("event_type").alias("action"), status.alias("status"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("created_ms"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"))


# The same frames as DuckDB CTEs, for the oracles.
SEG = """seg0 AS (SELECT conv_id AS doc_id, turn AS idx, role AS speaker, text, len(regexp_split_to_array(trim(text), '\\s+'))::BIGINT AS words, ((conv_id * 31 + turn * 17) % 100)::BIGINT AS conf FROM conversations),
seg1 AS (SELECT *, coalesce(sum(words * 400) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t0 FROM seg0),
seg AS (SELECT *, t0 + words * 400 AS t1 FROM seg1)"""
SEGW = """sw0 AS (SELECT doc_id, idx, t0, unnest(regexp_split_to_array(trim(text), '\\s+')) AS word, unnest(range(len(regexp_split_to_array(trim(text), '\\s+'))))::BIGINT AS k FROM seg),
sw AS (SELECT doc_id, idx, k, word, t0 + k * 400 AS w0, t0 + (k + 1) * 400 AS w1, ((k * 37 + idx * 11 + doc_id) % 100)::BIGINT AS p FROM sw0)"""
LINES = """ln0 AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, lang, source, unnest(ls) AS line, unnest(range(len(ls)))::BIGINT AS pos FROM ln0)"""
UTT = LINES + """, ut0 AS (SELECT doc_id, pos AS idx, 'S' || (length(line) % 3)::VARCHAR AS speaker, line AS text, len(regexp_split_to_array(trim(line), '\\s+'))::BIGINT AS words, (length(line) % 7 * 200)::BIGINT AS gap FROM ln WHERE trim(line) <> ''),
ut1 AS (SELECT *, coalesce(sum(words * 400 + gap) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t0 FROM ut0),
utt AS (SELECT doc_id, idx, speaker, text, words, t0, t0 + words * 400 AS t1 FROM ut1)"""
TURNS = UTT + """, tu0 AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY doc_id ORDER BY idx) = speaker THEN 0 ELSE 1 END AS fresh FROM utt),
tu1 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS turn FROM tu0),
turns AS (SELECT doc_id, turn, min(speaker) AS speaker, min(t0) AS s0, max(t1) AS s1 FROM tu1 GROUP BY doc_id, turn)"""
TWORDS = "tw AS (SELECT user_id AS doc_id, event_id, event_type AS word, epoch_us(ts) // 1000 AS w0, epoch_us(ts) // 1000 + 200 AS w1, least(100, floor(value))::BIGINT AS p FROM events)"
JOBS = """jobs AS (SELECT event_id AS id, user_id AS doc, event_type AS action, CASE WHEN value < 20 THEN 'pending' WHEN value < 60 THEN 'running' WHEN value < 160 THEN 'succeeded' ELSE 'failed' END AS status,
epoch_us(ts) // 1000 AS created_ms, floor(value * 10)::BIGINT AS duration_ms FROM events)"""
