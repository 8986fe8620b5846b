"""The lexical index as Parquet, kept up to date by small additions.

An addition writes a segment: the postings of the added chunks, by bucket of term, their lengths, and the ids whose rows in earlier
segments no longer count. Nothing written before is touched, so an addition costs what it adds. When the last few segments have one
level, compact() merges them into one of the next level, so that their number grows with the logarithm of the additions. What
belongs to the index is named in a version file, which is created once and never replaced; of two writers one fails.

A search reads only the buckets that hold its terms. Document counts are exact: each segment's live chunks are kept in the version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.operators import index, match
from vocalis.sources import files

POSTINGS = "term string, chunk_id string, field string, positions array<int>, n int, segment string, bucket int"
CHUNKS = "chunk_id string, n int, segment string"
REMOVED = "chunk_id string, segment string"


class ConflictError(RuntimeError):
    """Another writer changed the index meanwhile; nothing of this change is in it."""


@dataclass
class Store:
    spark: SparkSession
    path: str
    version: int
    buckets: int
    fields: list[str]
    segments: list[dict]

    def _read(self, what: str, schema: str, names: list[str] | None = None) -> DataFrame:
        own = [s["name"] for s in self.segments if s[what]] if names is None else names
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/segment={n}" for n in own])

    def _live(self, df: DataFrame) -> DataFrame:
        """Without the rows whose chunk a later segment removed."""
        if not any(s["removed"] for s in self.segments):
            return df
        gone = self._read("removed", REMOVED).select(F.col("chunk_id").alias("gone"), F.col("segment").alias("by"))
        return df.join(gone, (F.col("chunk_id") == F.col("gone")) & (F.col("by") > F.col("segment")), "left_anti")

    def postings(self, terms: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
        """(term, chunk_id, field, positions, n) of live chunks: of the given terms, from their buckets only, and of given prefixes."""
        df = self._read("postings", POSTINGS)
        if terms is not None:
            here = F.col("bucket").isin(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)) for t in terms]) & F.col("term").isin(*terms) if terms else F.lit(False)
            starts = F.lit(False)
            for p in prefixes or []:
                starts = starts | F.col("term").startswith(p)
            df = df.where(here).unionByName(df.where(starts & ~F.col("term").isin(*terms))) if prefixes else df.where(here)
        return self._live(df).select("term", "chunk_id", "field", "positions", "n")

    def corpus(self) -> DataFrame:
        return self.spark.createDataFrame([(sum(s["documents"] for s in self.segments), sum(s["tokens"] for s in self.segments))], "documents bigint, total bigint")

    def search(self, queries: DataFrame | str) -> DataFrame:
        """(query_id, chunk_id, score), for one query as text or a table (query_id, query).

        The text of one query that can't be read raises; its terms choose the buckets. A table's words are joined with all postings.
        """
        if isinstance(queries, str):
            plan = match.parse(queries)
            exact = sorted({w[5] for w in plan.words if not w[6]})
            postings = self.postings(exact, sorted({w[5] for w in plan.words if w[6]}))
            return match.search(postings, self.corpus(), self.spark.createDataFrame([("q", queries)], "query_id string, query string"))
        return match.search(self.postings(), self.corpus(), queries)


def open_store(spark: SparkSession, path: str) -> Store:
    """The newest version; an index that doesn't exist is empty."""
    known = [n for n in files.names(spark, f"{path}/versions") if n.endswith(".json")]
    if not known:
        return Store(spark, path, 0, 64, [], [])
    return Store(spark, path, **json.loads(files.read_text(spark, f"{path}/versions/{known[-1]}")))


def _commit(store: Store, segments: list[dict]) -> Store:
    version = store.version + 1
    state = {"version": version, "buckets": store.buckets, "fields": store.fields, "segments": segments}
    if not files.create_text(store.spark, f"{store.path}/versions/{version:012d}.json", json.dumps(state)):
        raise ConflictError(f"version {version} of {store.path} exists")
    return Store(store.spark, store.path, **state)


def _without(store: Store, ids: DataFrame) -> list[dict]:
    """The segments with their live chunks and tokens as they are without the given ids: one small row for each segment."""
    lost = store._live(store._read("chunks", CHUNKS)).join(ids, "chunk_id", "left_semi")
    lost = {r.segment: r for r in lost.groupBy("segment").agg(F.count("*").alias("k"), F.sum("n").alias("t")).collect()}
    return [s | {"documents": s["documents"] - lost[s["name"]].k, "tokens": s["tokens"] - lost[s["name"]].t} if s["name"] in lost else dict(s) for s in store.segments]


def _write(store: Store, name: str, postings: DataFrame, chunks: DataFrame) -> dict:
    bucket = F.pmod(F.xxhash64("term"), F.lit(store.buckets)).cast("int").alias("bucket")
    dealt = postings.select("term", "chunk_id", "field", "positions", F.col("n").cast("int").alias("n"), bucket).repartition("bucket").sortWithinPartitions("bucket", "term", "chunk_id")
    dealt.write.partitionBy("bucket").parquet(f"{store.path}/postings/segment={name}")
    chunks.select("chunk_id", F.col("n").cast("int").alias("n")).write.parquet(f"{store.path}/chunks/segment={name}")
    counts = store.spark.read.schema("chunk_id string, n int").parquet(f"{store.path}/chunks/segment={name}").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return {"documents": counts[0], "tokens": counts[1]}


def _name(store: Store) -> str:
    """In the order of versions; the rest keeps what two writers write apart."""
    return f"{store.version + 1:012d}-{uuid.uuid4().hex[:8]}"


def append(spark: SparkSession, path: str, chunks: DataFrame, fields: list[str], buckets: int = 64) -> Store:
    """Adds chunks: (chunk_id, *fields). A chunk whose id is there already is replaced; of rows with one id the least texts count.

    Rows without an id are left out; a null text has no words. ``buckets`` counts for a new index only.
    """
    store = open_store(spark, path)
    if not store.version:
        store.buckets, store.fields = buckets, list(fields)
    if store.fields != list(fields):
        raise ValueError(f"the index has the fields {store.fields}")
    name = _name(store)
    texts = chunks.where("chunk_id is not null").groupBy(F.col("chunk_id").cast("string").alias("chunk_id")).agg(F.min(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])).alias("t"))
    words = texts.select("chunk_id", F.array(*[F.struct(F.lit(f).alias("field"), index.terms(F.col(f"t.{f}")).alias("words")) for f in fields]).alias("w"))
    words = words.withColumn("n", F.aggregate("w", F.lit(0), lambda n, w: n + F.size(w["words"])))
    counts = _write(store, name, index.placed(words.select("chunk_id", "n", F.inline("w"))), words)
    ids = spark.read.schema("chunk_id string, n int").parquet(f"{path}/chunks/segment={name}").select("chunk_id")
    return _replace(store, name, ids, {"postings": True, "chunks": True, **counts})


def delete(spark: SparkSession, path: str, ids: DataFrame) -> Store:
    """Removes the chunks with the given ids (chunk_id); ids that aren't there do nothing."""
    store = open_store(spark, path)
    gone = ids.select(F.col("chunk_id").cast("string").alias("chunk_id")).where("chunk_id is not null").distinct()
    return _replace(store, _name(store), gone, {"postings": False, "chunks": False, "documents": 0, "tokens": 0})


def _replace(store: Store, name: str, ids: DataFrame, segment: dict) -> Store:
    """Commits a segment that removes the given ids from earlier ones; only ids that are there are written."""
    segments, removed = store.segments, False
    if segments:
        there = store._live(store._read("chunks", CHUNKS)).join(ids, "chunk_id", "left_semi")
        there.select("chunk_id").distinct().write.parquet(f"{store.path}/removed/segment={name}")
        gone = store.spark.read.schema("chunk_id string").parquet(f"{store.path}/removed/segment={name}")
        segments = _without(store, gone)
        removed = not gone.isEmpty()
    return _commit(store, [*segments, {"name": name, "level": 0, "removed": removed, **segment}])


def compact(spark: SparkSession, path: str, fan: int = 4) -> Store:
    """Merges the last segments, ``fan`` or more of one level, into one of the next, until no such run is left at the end.

    The merged segment has the live postings; ids that its parts removed from earlier segments stay removed there.
    """
    store = open_store(spark, path)
    while True:
        run = []
        for s in reversed(store.segments):
            if run and s["level"] != run[0]["level"]:
                break
            run.insert(0, s)
        if len(run) < fan:
            return store
        rest, name = store.segments[: len(store.segments) - len(run)], _name(store)
        part = Store(store.spark, store.path, store.version, store.buckets, store.fields, run)
        counts = _write(store, name, part.postings(), part._live(part._read("chunks", CHUNKS)))
        removed = bool(rest) and any(s["removed"] for s in run)
        if removed:
            part._read("removed", REMOVED).select("chunk_id").distinct().write.parquet(f"{path}/removed/segment={name}")
        store = _commit(store, [*rest, {"name": name, "level": run[0]["level"] + 1, "removed": removed, "postings": True, "chunks": True, **counts}])


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the segments that the newest version doesn't name; searches of older versions end. Returns how many folders went."""
    store, gone = open_store(spark, path), 0
    for what in ("postings", "chunks", "removed"):
        live = {f"segment={s['name']}" for s in store.segments if s[what]}
        for n in files.names(spark, f"{path}/{what}"):
            if n not in live:
                files.remove(spark, f"{path}/{what}/{n}")
                gone += 1
    return gone
