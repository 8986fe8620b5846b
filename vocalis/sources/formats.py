"""What scans and text sinks share: coalescing of spellings, JSON lines with corrupt rows, ordered joins of lines, time formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SCHEMA_VERSION = "1.0.0"


def first_true(*names: str) -> Column:
    """The first value that isn't null or 0; the last spelling counts even if it is 0."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit(0.0)) for n in names[:-1]], F.col(names[-1]), F.lit(0.0))


def first_available(df: DataFrame) -> DataFrame:
    """Of (doc_id, priority, text) the text of least priority per document."""
    return df.groupBy("doc_id").agg(F.min("priority").alias("priority"), F.min_by("text", "priority").alias("text"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])


def parse_json_lines(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds the schema's columns and ``corrupt``: whether the line is no JSON."""
    parsed = F.from_json(F.col(column), f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    out = df.withColumn("__parsed", parsed).withColumn("corrupt", F.col("__parsed.__bad").isNotNull() | F.col("__parsed").isNull())
    return out.select("*", "__parsed.*").drop("__parsed", "__bad")


def joined_lines(df: DataFrame, line: Column, separator: str = "\n", order: str = "idx") -> DataFrame:
    """(doc_id, body): each document's lines in order."""
    rows = df.select("doc_id", F.col(order).alias("__order"), line.alias("__line"))
    ordered = F.array_sort(F.collect_list(F.struct("__order", "__line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["__line"]), separator).alias("body"))


def _two(c: Column) -> Column:
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.lit(2), F.length(text)), F.lit("0"))


def minutes(ms: Column) -> Column:
    """MM:SS"""
    return F.concat(_two(F.floor(ms / 60_000)), F.lit(":"), _two(F.floor(ms / 1000) % 60))


def stamp(ms: Column, mark: str) -> Column:
    """HH:MM:SS,mmm"""
    return F.concat(_two(F.floor(ms / 3_600_000)), F.lit(":"), _two(F.floor(ms / 60_000) % 60), F.lit(":"), _two(F.floor(ms / 1000) % 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def stamp_schema(df: DataFrame) -> DataFrame:
    """Null versions become the current one; others raise."""
    version = F.coalesce("schema_version", F.lit(SCHEMA_VERSION))
    return df.withColumn("schema_version", F.when(version == SCHEMA_VERSION, version).otherwise(F.raise_error(F.concat(F.lit("unknown schema version "), version)).cast("string")))


def windows(df: DataFrame, total: str, length_ms: int, overlap_ms: int) -> DataFrame:
    """(doc_id, idx, start_ms, end_ms): overlapping windows while a start is below the total; the last ones are cut short."""
    hop = length_ms - overlap_ms
    starts = df.where(F.col(total) > 0).select("doc_id", total, F.posexplode(F.sequence(F.lit(0).cast("long"), F.col(total) - 1, F.lit(hop).cast("long"))).alias("idx", "start_ms"))
    return starts.select("doc_id", F.col("idx").cast("long").alias("idx"), "start_ms", F.least(F.col("start_ms") + length_ms, F.col(total)).alias("end_ms"))


def plain_lines(s: DataFrame) -> DataFrame:
    return joined_lines(s, F.concat(F.when(F.col("speaker") != "", F.concat("speaker", F.lit(": "))).otherwise(""), "text"))


def markdown(s: DataFrame) -> DataFrame:
    return joined_lines(s, F.concat(F.lit("## "), minutes(F.col("t0")), F.lit(" "), "speaker", F.lit("\n"), "text"))


def subtitles(s: DataFrame, mark: str) -> DataFrame:
    numbered = s.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("idx")))
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), stamp(F.col("t0"), mark), F.lit(" --> "), stamp(F.col("t1"), mark), F.lit("\n"), "text")
    return joined_lines(numbered, cue, "\n\n")


def json_document(s: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("idx", "t0", "t1", "speaker", "text")))
    meta = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.count("*").alias("segments"))
    return s.groupBy("doc_id").agg(F.to_json(F.struct(meta.alias("meta"), rows.alias("segments"))).alias("body"))


def json_rows(s: DataFrame) -> DataFrame:
    return joined_lines(s, F.to_json(F.struct("idx", "t0", "t1", "speaker", "text")))


def clean_text(s: DataFrame, rows: int = 4) -> DataFrame:
    head = F.when(F.col("idx") % rows == 0, F.concat(F.lit("# Section "), (F.floor(F.col("idx") / rows) + 1).cast("string"), F.lit("\n"))).otherwise("")
    return joined_lines(s, F.concat(head, "text"))


#: Export formats by name: from (doc_id, idx, speaker, text, t0, t1) to (doc_id, body).
RENDERERS = {
    "txt": plain_lines,
    "md": markdown,
    "json": json_document,
    "jsonl": json_rows,
    "srt": lambda s: subtitles(s, ","),
    "vtt": lambda s: subtitles(s, "."),
    "clean_txt": clean_text,
}
