"""Writers with a fixed order of rows and keys."""

from __future__ import annotations

import json
import time
import warnings
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.sources import files


def write_json_document(spark: SparkSession, path: str, payload: Any, sort_keys: bool = False) -> None:
    """One small JSON document with indents and a line end, replaced at once."""
    files.write_text(spark, path, json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=sort_keys) + "\n")


def prepare(spark: SparkSession, path: str, force: bool = False, dry_run: bool = False) -> bool:
    """Whether to write to a target: an existing one raises unless forced, and is deleted then; a dry run writes and deletes nothing."""
    there = files.exists(spark, path)
    if there and not force:
        raise FileExistsError(f"{path} exists; force to overwrite")
    if dry_run:
        return False
    if there:
        files.remove(spark, path)
    return True


def write_stage(df: DataFrame, path: str, version: str) -> None:
    """A stage's result, and then its version: readers.stage_output() takes it only with the version that it asks for."""
    files.remove(df.sparkSession, f"{path}.version")
    df.write.mode("overwrite").parquet(path)
    files.write_text(df.sparkSession, f"{path}.version", version)


def write_run(spark: SparkSession, path: str, started: float, stages: list[dict], artifacts: dict[str, str], error: str | None = None, **more: Any) -> dict:
    """The manifest of a run, replaced at once: status, times, stages, and each artifact's path and bytes."""
    ended = time.time()
    iso = lambda t: datetime.fromtimestamp(t, UTC).isoformat()
    sizes = {}
    for name, place in artifacts.items():
        fs, where = files._at(spark, place)
        sizes[name] = fs.getContentSummary(where).getLength() if fs.exists(where) else None
    manifest = {"status": "failed" if error else "ok", "error": error, "start": iso(started), "end": iso(ended), "duration_sec": round(ended - started, 3), "stages": stages, "exports": sorted(artifacts), "export_paths": artifacts, "export_bytes": sizes, **more}
    write_json_document(spark, path, manifest)
    return manifest


def write_formats(segments: DataFrame, path: str, formats: list[str], force: bool = False, dry_run: bool = False) -> dict[str, str]:
    """Each named export of (doc_id, idx, speaker, text, t0, t1) as (doc_id, body); an unknown format warns and is left out.

    Names are trimmed, in any case, once each. Returns the path of each format that was written (in a dry run: would be).
    """
    from vocalis.sources.formats import RENDERERS

    names = list(dict.fromkeys(f.strip().lower() for f in formats if f.strip()))
    for name in [n for n in names if n not in RENDERERS]:
        warnings.warn(f"unknown export format: {name}", stacklevel=2)
    out = {n: f"{path}/{n}" for n in names if n in RENDERERS}
    for name, place in out.items():
        if prepare(segments.sparkSession, place, force, dry_run):
            RENDERERS[name](segments).write.parquet(place)
    return out


def write_postprocess(phrases: DataFrame, path: str, orphans: DataFrame | None = None, flag: str = "⚠️", heading: str = "Phrases à vérifier", force: bool = False, dry_run: bool = False) -> dict[str, DataFrame]:
    """Normalised lines, final text, Markdown and quality counts of edited phrases: (doc_id, idx, speaker, text, dropped, flagged).

    ``normalized`` has one line for each phrase, blank for a dropped one, so that lines stay 1:1; ``final`` has the others as
    paragraphs, flagged ones behind the flag, and the orphans (doc_id, text) as an annex; ``markdown`` sets speakers in bold.
    """
    said = F.when(F.coalesce("dropped", F.lit(False)), F.lit("")).otherwise(F.trim("text"))
    kept = phrases.withColumn("said", said).withColumn("mark", F.when(F.coalesce("flagged", F.lit(False)), F.lit(f"{flag} ")).otherwise(""))
    speaker = F.when(F.coalesce("speaker", F.lit("")) != "", F.col("speaker"))
    line = F.when(F.col("said") == "", "").otherwise(F.concat(F.coalesce(F.concat(speaker, F.lit(": ")), F.lit("")), "said"))

    def joined(df: DataFrame, text, between: str, name: str) -> DataFrame:
        rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", text.alias("line")))), lambda r: r["line"])
        return df.groupBy("doc_id").agg(F.array_join(rows, between).alias(name))

    alive = kept.where("said <> ''")
    normalized = joined(kept, line, "\n", "body").select("doc_id", F.concat(F.rtrim("body"), F.lit("\n")).alias("body"))
    final = joined(alive, F.concat(F.coalesce(F.concat(speaker, F.lit(" : ")), F.lit("")), "mark", "said"), "\n\n", "body")
    markdown = joined(alive, F.concat(F.coalesce(F.concat(F.lit("**"), speaker, F.lit("** : ")), F.lit("")), "mark", "said"), "\n\n", "body")
    documents = phrases.select("doc_id").distinct()
    if orphans is not None:
        loose = orphans.where(F.trim("text") != "").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.trim("text")))), "\n").alias("annex"))
        annexed = F.concat_ws("\n\n", "body", F.concat(F.lit(f"{flag} {heading}\n\n"), "annex"))
        final, markdown = (documents.join(d, "doc_id", "left").join(loose, "doc_id", "left").select("doc_id", annexed.alias("body")) for d in (final, markdown))
    ended = lambda d: documents.join(d, "doc_id", "left").select("doc_id", F.concat(F.coalesce("body", F.lit("")), F.lit("\n")).alias("body"))
    counts = kept.groupBy("doc_id").agg(F.count("*").alias("phrases"), F.count_if(F.col("said") == "").alias("dropped"), F.count_if((F.col("said") != "") & (F.col("mark") != "")).alias("flagged"), F.sum(F.length("said")).alias("characters"))
    out = {"normalized": normalized, "final": ended(final), "markdown": ended(markdown), "qa": counts}
    for name, df in out.items():
        if prepare(phrases.sparkSession, f"{path}/{name}", force, dry_run):
            df.write.parquet(f"{path}/{name}") if name != "qa" else df.write.json(f"{path}/{name}")
    return out


def write_json_lines(df: DataFrame, path: str, order: list[str], force: bool = False) -> None:
    """JSON lines, keys sorted, rows ordered over all files. Refuses an existing target unless forced."""
    ordered = df.select(*sorted(df.columns)).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite" if force else "errorifexists").json(path)


def write_text(df: DataFrame, path: str, column: str, key: str, force: bool = False) -> None:
    """One folder of text per key."""
    df.select(F.col(column).alias("value"), F.col(key).alias("__key")).write.mode("overwrite" if force else "errorifexists").partitionBy("__key").text(path)


def write_index(index, path: str, buckets: int = 64, force: bool = False) -> None:
    """postings by bucket of term, lengths and corpus, as Parquet folders."""
    mode = "overwrite" if force else "errorifexists"
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket")
    index.postings.select("*", bucket).repartition(buckets, "bucket").sortWithinPartitions("term", "chunk_id").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    index.lengths.write.mode(mode).parquet(f"{path}/lengths")
    index.corpus.write.mode(mode).parquet(f"{path}/corpus")
