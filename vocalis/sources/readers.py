"""Readers of the file formats: segment documents, JSON lines, manifests, rule files."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.sources import config, files

WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("probability", T.DoubleType()), T.StructField("score", T.DoubleType())])
SEGMENT = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("text_human", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("words", T.ArrayType(WORD))])
DOCUMENT = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("language", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT))])


def segment_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of JSON documents: path, idx, start_ms, end_ms, text (human text first), speaker, confidence, words, n_words.

    The confidence is the given one, or the mean of the words' scores, or null. Paths may be any that Spark reads.
    """
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "segments")
    s = docs.select("path", F.posexplode("segments").alias("idx", "s"))
    scores = F.filter(F.transform("s.words", lambda w: F.coalesce(w["score"], w["probability"])), lambda x: x.isNotNull())
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    text = F.coalesce(F.nullif(F.col("s.text_human"), F.lit("")), F.col("s.text"), F.lit(""))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return s.select("path", "idx", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), text.alias("text"), "s.speaker", F.round(F.coalesce("s.confidence", mean), 3).alias("confidence"), "s.words", F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).alias("n_words"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with ``corrupt``: the text of a line that doesn't parse, or null."""
    return spark.read.schema(f"{schema}, corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("`index` int, start_ms bigint, end_ms bigint, path string, status string").csv(path, header=True)


def rule_lines(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Rules from JSON lines {pattern, replacement}; entries without a pattern are skipped. A rule file is small and goes to the driver."""
    out = []
    for line in files.read_text(spark, path).splitlines():
        try:
            entry = json.loads(line)
        except ValueError:
            continue
        if isinstance(entry, dict) and entry.get("pattern"):
            out.append((entry["pattern"], entry.get("replacement", "")))
    return out


def rule_file(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Rules from a YAML or JSON mapping with the list ``rules``; entries without a pattern or a replacement are skipped, a missing file has none."""
    if not files.exists(spark, path):
        return []
    rules = config.load(spark, path).get("rules")
    entries = [e for e in rules if isinstance(e, dict)] if isinstance(rules, list) else []
    return [(str(e["pattern"]), str(e["replacement"])) for e in entries if e.get("pattern") and e.get("replacement") is not None]


def _term(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text).split()).lower()


def term_list(spark: SparkSession, entries: Iterable[str] = (), path: str | None = None) -> DataFrame:
    """(term): distinct terms given inline and by line in a file, where blank lines and comments (#) are skipped."""
    lines = files.read_text(spark, path).splitlines() if path and files.exists(spark, path) else []
    named = [*entries, *(line for line in lines if not line.strip().startswith("#"))]
    return spark.createDataFrame([(t,) for t in sorted({_term(e) for e in named} - {""})], "term string")


def term_pairs(spark: SparkSession, entries: Iterable[tuple[str, str] | str] = (), path: str | None = None) -> DataFrame:
    """(term, preferred): pairs given inline, as tuples or with a tab, and by line in a file; the last of a term wins."""
    lines = files.read_text(spark, path).splitlines() if path and files.exists(spark, path) else []
    found: dict[str, str] = {}
    for entry in [*entries, *(line for line in lines if not line.strip().startswith("#"))]:
        pair = entry.strip("\r\n").split("\t", 1) if isinstance(entry, str) else list(entry)[:2]
        if len(pair) == 2 and _term(pair[0]):
            found[_term(pair[0])] = pair[1].strip()
    return spark.createDataFrame(sorted(found.items()), "term string, preferred string")


def stage_output(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """The stored result of a stage if it is there, complete and of that version; else null, and the stage has to run."""
    if not files.exists(spark, f"{path}/_SUCCESS") or not files.exists(spark, f"{path}.version"):
        return None
    return spark.read.parquet(path) if files.read_text(spark, f"{path}.version") == version else None


def index(spark: SparkSession, path: str):
    """The lexical index that sinks.write_index stored, sorted by term: a search reads the row groups that can hold its terms."""
    from vocalis.operators.index import Index

    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "lengths", "corpus")))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Directory, name, size and time of files; their content isn't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return f.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "modificationTime")
