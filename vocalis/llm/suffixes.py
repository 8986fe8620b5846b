"""Suffix-array deduplication over bytes with a logarithmic family of indexes.

The strings of 50 bytes are dealt to buckets as super-k-mers (see shards.py), so that equal strings meet. Inside a bucket, text
comes in batches in document order. Each new batch gets a suffix array of its own (positions in order of their suffixes); it is
scanned in merge order against the suffix arrays of the existing levels, which finds every match of 50 bytes or more with an
earlier document; then it enters the lowest level, and levels of equal size merge, so that a bucket has at most log2(batches)
levels. Suffixes are compared on their first 50 bytes only: longer matches are runs of such matches.

repeated_bytes() builds the family for one table and forgets it. append() keeps it: levels are stored by bucket, a new table is
one batch, scanned against what is stored, and only the levels that merge are written again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm import shards
from vocalis.llm.frames import narrow
from vocalis.llm.kernels import NULL_ID, U64, Chunk, loads, mix, prefix_hash, range_hash, ranges
from vocalis.llm.substrings import tags

SPAN, M = 50, 8
WIDTH = SPAN - M + 1
#: Bytes on one side of the minimiser that every window has on its left or its right.
SIDE = (SPAN - M) // 2
BATCH = 1 << 16


def byte_mmers(chunk: Chunk) -> list[np.ndarray]:
    h = loads(chunk.buf)
    return [mix(h[low : low + shards.SEGMENT].copy()) for low in range(0, len(h), shards.SEGMENT)]


def byte_pieces(chunk: Chunk, route: shards.Routing) -> shards.Pieces:
    n = len(chunk.buf)
    valid = np.zeros(max(0, n - SPAN + 1), dtype=bool)
    size = np.maximum(chunk.ends - chunk.starts - SPAN + 1, 0)
    valid[ranges(chunk.starts, size)] = True
    runs = shards.super_kmers(np.concatenate([*byte_mmers(chunk), np.zeros(0, dtype=U64)]), valid, WIDTH, route)
    owner = np.searchsorted(chunk.ends, runs.first, side="right")
    end = runs.first + runs.count + SPAN - 1
    same = range_hash(prefix_hash(chunk.buf), runs.first, end)
    return shards.Pieces(chunk.ids[owner], tags(chunk)[owner], runs.first - chunk.starts[owner], runs.count, runs.anchor - runs.first, runs.first, end - runs.first, runs.bucket, same, chunk.buf)


def _shared(p: dict[str, np.ndarray], buf: np.ndarray) -> np.ndarray:
    """Pieces that can have a string in common with another document.

    Each window holds its minimiser and SIDE bytes more on its left or on its right. If neither of a piece's two strings of
    that kind occurs in another document, none of its windows does.
    """
    h = loads(buf)
    anchor = p["at"] + p["anchor"]
    keep = np.zeros(len(anchor), dtype=bool)
    for low, possible in ((anchor - SIDE, p["anchor"] >= SIDE), (anchor, p["anchor"] + M + SIDE <= p["length"])):
        who = np.flatnonzero(possible)
        at = low[who]
        key = mix(h[at])
        for k in (8, 16, SIDE):  # four loads of 8 bytes cover M + SIDE = 29 bytes
            key = mix(key ^ h[at + k])
        order = np.lexsort((p["doc"][who], key))
        key, doc = key[order], p["doc"][who][order]
        lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=int)
        last = np.append(lead[1:], len(key)) - 1
        many = doc[lead] != doc[last] if len(key) else np.zeros(0, dtype=bool)
        keep[who[order[np.repeat(many, last - lead + 1)]]] = True
    return keep


def _strings(buf: np.ndarray) -> np.ndarray:
    """The SPAN bytes at each position as one value: a view."""
    return np.lib.stride_tricks.as_strided(buf[:SPAN].view(f"S{SPAN}"), shape=(len(buf) - SPAN + 1,), strides=(1,)) if len(buf) >= SPAN else np.zeros(0, dtype=f"S{SPAN}")


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, dtype=np.int64)


class Level:
    """A suffix array: positions in a text in the order of their strings, no string twice, each with the smallest document that has it."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, docs: np.ndarray):
        self.buf, self.at, self.docs = buf, at, docs

    @classmethod
    def of(cls, buf: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[Level, np.ndarray]:
        """The level of a batch, and for each of its positions the place of its string in it."""
        keys = _strings(buf)[at]
        order = np.argsort(keys, kind="stable")
        lead = _runs(keys[order])
        place = np.empty(len(at), dtype=np.int64)
        place[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(at))))
        return cls(buf, at[order[lead]], np.minimum.reduceat(docs[order], lead) if len(lead) else docs), place

    def strings(self) -> np.ndarray:
        return _strings(self.buf)[self.at]

    def earliest(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scans sorted strings against this level: the smaller of ``docs`` and the level's document with the same string.

        Both run in order, so the scan only moves forward; against a much larger level it leaps.
        """
        if not len(self.at) or not len(keys):
            return docs
        mine = self.strings()
        if len(mine) > 8 * len(keys):
            at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
            return np.where(mine[at] == keys, np.minimum(docs, self.docs[at]), docs)
        both = np.concatenate((mine, keys))
        order = np.argsort(both, kind="stable")  # two sorted runs: one merge
        lead = _runs(both[order])
        least = np.minimum.reduceat(np.concatenate((self.docs, docs))[order], lead)
        out = np.empty(len(both), dtype=np.int64)
        out[order] = np.repeat(least, np.diff(np.append(lead, len(both))))
        return out[len(mine) :]

    def merged(self, other: Level) -> Level:
        """Both in one; texts are put one after the other unless they are the same."""
        same = self.buf is other.buf
        buf = self.buf if same else np.concatenate((self.buf, other.buf))
        keys = np.concatenate((self.strings(), other.strings()))
        at, docs = np.concatenate((self.at, other.at + (0 if same else len(self.buf)))), np.concatenate((self.docs, other.docs))
        order = np.argsort(keys, kind="stable")
        lead = _runs(keys[order])
        return Level(buf, at[order[lead]], np.minimum.reduceat(docs[order], lead) if len(lead) else docs)

    def packed(self) -> bytes:
        """Position and document of each string, and the text that they need."""
        used = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.add.at(used, self.at, 1)
        np.subtract.at(used, self.at + SPAN, 1)
        keep = np.cumsum(used[:-1]) > 0
        return shards.pack([(np.cumsum(keep) - 1)[self.at], self.docs], self.buf[keep].tobytes())

    @classmethod
    def unpacked(cls, blob: bytes) -> Level:
        (at, docs), text = shards.unpack(blob)
        return cls(np.frombuffer(text, dtype=np.uint8), at, docs)


class Family:
    """Level i holds the strings of 2**i batches, or nothing."""

    def __init__(self, levels: list[Level | None] | None = None) -> None:
        self.levels: list[Level | None] = levels or []

    def scan(self, new: Level) -> np.ndarray:
        """For each string of a new batch the smallest document that has it, there or in the levels."""
        keys, found = new.strings(), new.docs
        for level in self.levels:
            if level is not None:
                found = level.earliest(keys, found)
        return found

    def add(self, buf: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes a batch of positions and their documents; returns which strings occur in a smaller document here or in the levels."""
        new, place = Level.of(buf, at, docs)
        found = self.scan(new)
        later = docs > found[place] if len(at) else np.zeros(0, dtype=bool)
        new = Level(buf, new.at, found)
        for i in range(len(self.levels) + 1):
            if i == len(self.levels):
                self.levels.append(new)
                break
            if self.levels[i] is None:
                self.levels[i] = new
                break
            new, self.levels[i] = self.levels[i].merged(new), None
        return later


def _batches(p: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces (sorted by document) in batches of about BATCH windows: each window's position, and its piece."""
    upto = np.cumsum(p["count"])
    low = 0
    while low < len(upto):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + BATCH, side="right")))
        own = slice(low, high)
        yield ranges(p["at"][own], p["count"][own]), np.repeat(np.arange(low, high), p["count"][own])
        low = high


def _in_order(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((p["start"], p["tag"], p["doc"]))
    return {f: c[order] for f, c in p.items()}


def matches(p: dict[str, np.ndarray], buf: np.ndarray) -> list[np.ndarray]:
    if not len(p["doc"]):
        return [np.zeros(0, dtype=np.int64)] * 4
    keep = _shared(p, buf)
    p = _in_order({f: c[keep] for f, c in p.items()})
    family, found = Family(), []
    for at, piece in _batches(p):
        gone = np.flatnonzero(family.add(buf, at, p["doc"][piece]))
        piece, at = piece[gone], at[gone]
        found.append(shards.window_ranges(p["doc"][piece], p["tag"][piece], p["start"][piece] + at - p["at"][piece], SPAN))
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(4)]


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def repeated_bytes(docs: DataFrame, text_as: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``text_as`` also the text that is left, and
    the columns named in ``carry`` unchanged.

    A byte goes if a string of 50 bytes that covers it also starts in a document of smaller id. A null text is empty, and a
    shorter text keeps all its bytes; repeats inside one document stay. What is left of a character that loses some of its
    bytes is dropped from the text but not from the digest. A null id counts as the smallest; rows of one id never remove
    each other's bytes. An empty table gives an empty result.
    """
    route = shards.routing(docs, byte_mmers)
    return _without(docs, shards.removed(docs, byte_pieces, matches, False, SPAN, route), route.groups, text_as, carry)


def _without(docs: DataFrame, found: DataFrame, groups: int, text_as: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    schema = T.StructType([*DIGEST.fields, *([T.StructField(text_as, T.StringType())] if text_as else []), *narrow(docs, *carry).schema.fields])

    def finish(spans: dict, texts: pa.Table) -> pa.Table:
        rows, left_texts = [], []
        for key, text in zip(texts.column(0).to_pylist(), texts.column(1).cast(pa.binary()).to_pylist(), strict=True):
            raw = text or b""
            own = spans.get((NULL_ID if key is None else key, zlib.crc32(raw)), ())
            kept, at = [], 0
            for a, b in own:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((key, len(raw), len(raw) - len(left), len(own), hashlib.sha256(left).hexdigest()))
            left_texts.append(None if text is None else left.decode("utf-8", "ignore"))
        columns = {f.name: pa.array([r[i] for r in rows], pa.string() if i == 4 else pa.int64()) for i, f in enumerate(DIGEST.fields)}
        if text_as:
            columns[text_as] = pa.array(left_texts, pa.string())
        return pa.table(list(columns.values()) + texts.columns[2:], names=list(columns) + list(carry))

    return shards.apply_ranges(docs, found, groups, finish, schema, carry)


STATE = "generation int, batches int, buckets int, bins binary, folders array<struct<level int, folder string>>"


def append(docs: DataFrame, path: str, buckets: int = 256) -> DataFrame:
    """Takes a table as the next batch of the family that is stored at ``path`` (none yet: the first), and returns repeated_bytes()'s rows for it.

    A byte goes if a string of 50 bytes that covers it also starts in a document of smaller id, in this batch or an earlier one;
    earlier batches aren't judged again, so ids should grow from batch to batch. Buckets, and which strings count as frequent when
    pieces are cut, are set by the first batch. Each append writes one level, merged from the new batch and the lower levels; its
    state counts when it is complete, so that an append that fails can be done again.
    """
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    if home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home):
        state = spark.read.schema(STATE).parquet(f"{path}/state/*").orderBy(F.desc("generation")).first()
        hot = np.unpackbits(np.frombuffer(state.bins, dtype=np.uint8)).astype(bool)
        generation, batches, buckets, folders = state.generation + 1, state.batches, state.buckets, {f.level: f.folder for f in state.folders}
    else:
        hot = shards.routing(docs, byte_mmers).hot
        generation, batches, folders = 0, 0, {}
    groups = shards.prime(max(buckets // 2, 2))
    route = shards.Routing(hot, buckets, groups)
    target = (~batches & (batches + 1)).bit_length() - 1  # the levels below are full and merge with the batch
    sent = shards.sent(docs, byte_pieces, False, SPAN, route).withColumn("level", F.lit(-1))
    stored = [spark.read.schema("bucket bigint, blob binary").parquet(f"{path}/{folder}").withColumn("level", F.lit(level)) for level, folder in folders.items()]
    for s in stored:
        sent = sent.unionByName(s)

    def settle(table: pa.Table) -> pa.Table:
        levels, blobs = table.column("level").to_pylist(), table.column("blob").to_pylist()
        known: list[Level | None] = [None] * max(target, *(v + 1 for v in levels))
        for v, blob in zip(levels, blobs, strict=True):
            if v >= 0:
                known[v] = Level.unpacked(blob)
        columns, buf, before = shards.received([b for v, b in zip(levels, blobs, strict=True) if v < 0])
        p = _in_order(columns)
        at, piece = ranges(p["at"], p["count"]), np.repeat(np.arange(len(p["count"])), p["count"])
        new, place = Level.of(buf, at, p["doc"][piece])
        least = Family(known).scan(new)
        gone = np.flatnonzero(p["doc"][piece] > least[place]) if len(at) else np.zeros(0, dtype=np.int64)
        found = shards.window_ranges(p["doc"][piece[gone]], p["tag"][piece[gone]], (p["start"][piece] + at - p["at"][piece])[gone], SPAN)
        packed = shards.by_group([np.concatenate((a, b)) for a, b in zip(before, found, strict=True)], groups)
        new = Level(buf, new.at, least)
        for level in known[:target]:
            new = new if level is None else level.merged(new)
        rows = packed.num_rows
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"part": pa.concat_arrays([*packed.column("part").chunks, pa.array([bucket], pa.int64())]), "blob": pa.concat_arrays([*packed.column("blob").chunks, pa.array([new.packed()], pa.binary())]), "is_level": pa.array([False] * rows + [True])})

    work, level = f"work-{generation}", f"level-{generation}"
    sent.groupBy("bucket").applyInArrow(settle, "part bigint, blob binary, is_level boolean").write.mode("overwrite").parquet(f"{path}/{work}")
    done = spark.read.parquet(f"{path}/{work}")
    done.where("is_level").select(F.col("part").alias("bucket"), "blob").write.mode("overwrite").parquet(f"{path}/{level}")
    folders = {v: f for v, f in folders.items() if v >= target} | {target: level}
    state = [(generation, batches + 1, buckets, bytearray(np.packbits(hot).tobytes()), sorted(folders.items()))]
    spark.createDataFrame(state, STATE).write.mode("overwrite").parquet(f"{path}/state/{generation}")
    return _without(docs, done.where("not is_level").select("part", "blob"), groups)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what repeats from smaller ids cut out; documents of which nothing is left go, unless they were empty before."""
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # names that can't clash with the digests'
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = repeated_bytes(renamed, "__left", tuple(names.values())).where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_bytes"))))
    return out.select(*[F.col("__left" if c == "text" else names.get(c, c)).alias(c) for c in docs.columns])
