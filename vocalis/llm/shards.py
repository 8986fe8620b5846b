"""Super-k-mers: how runs of consecutive windows travel so that equal windows meet in one bucket.

A window is a fixed number of consecutive units (words or bytes). Its minimiser is the m-mer of least hash inside it, the
leftmost of several. Consecutive windows with the same minimiser form a super-k-mer and go, as one packed string, to the
bucket that the minimiser's hash names; equal windows have equal minimisers and so meet there, whatever stands around them.

Skew: m-mers that make up a large part of all (a common line, a passage that many documents share) are counted over the
whole corpus first and come last in the order, so that a window around one picks another minimiser. Runs that repeat inside a
task are judged there; only the first of them travels, so that copies don't gather in a bucket.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm.frames import narrow, saved, shuffle_partitions
from vocalis.llm.kernels import NULL_ID, U64, Chunk, chunks, mix, ranges, sliding_min

#: m-mers are counted by this many bits of their hash; the table has a fixed size whatever the corpus has.
HOT_BITS = 20
_POSITION_BITS = U64(24)
SEGMENT = 2 << 20
LEVEL = 3
#: Text that one task gathers before it sends, and text that a bucket should hold.
FLUSH_BYTES, BUCKET_BYTES = 12 << 20, 4 << 20


@dataclass
class Routing:
    hot: np.ndarray  # 2**HOT_BITS flags
    buckets: int
    groups: int  # groups of documents in which results are put together


def prime(n: int) -> int:
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def routing(docs: DataFrame, mmers: Callable[[Chunk], Iterable[np.ndarray]], share: float | None = None, slack: int = 8, bits: int = HOT_BITS) -> Routing:
    """Counts the m-mers of all documents. Only sums of bins that are frequent in some task leave it.

    share: of all m-mers, from which a bin is hot; slack: how many times less is enough, as tasks where a bin is rare don't report it.
    """
    parts = shuffle_partitions(docs.sparkSession)
    share = share or max(8 / (1 << bits), 1 / (200 * parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = np.zeros(1 << bits, dtype=np.int64), 0
        for _, chunk in chunks(batches):
            size += len(chunk.buf)
            for h in mmers(chunk):
                table += np.bincount((h >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
        bins = np.flatnonzero(table >= max(16, share * table.sum()))
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *bins.tolist()], pa.int64()), pa.array([size, int(table.sum()), *table[bins].tolist()], pa.int64())], ["bin", "n"])

    found = {r.bin: r.n for r in narrow(docs, "doc_id", "text").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    hot = np.zeros(1 << bits, dtype=bool)
    hot[[b for b, n in found.items() if b >= 0 and n >= share * found[-1] / slack]] = True
    size = found.get(-2, 0)
    return Routing(hot, max(parts, -(-size // BUCKET_BYTES)), prime(max(parts, -(-size // (2 * BUCKET_BYTES)))))


@dataclass
class Runs:
    """Super-k-mers of one chunk: first window, number of windows, minimiser position and bucket."""

    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    bucket: np.ndarray


def super_kmers(hashes: np.ndarray, valid: np.ndarray, width: int, route: Routing) -> Runs:
    """hashes: of the m-mers, one per position; valid: of the windows, one per position; width: m-mers in a window."""
    found = []
    for low in range(0, len(valid), SEGMENT):
        h = hashes[low : low + SEGMENT + width - 1]
        key = h >> U64(1)
        key |= route.hot[(h >> U64(64 - HOT_BITS)).astype(np.int64)].astype(U64) << U64(63)
        key = (key >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(key), dtype=U64)
        least = sliding_min(key, width)
        ok = valid[low : low + len(least)]
        least = least[: len(ok)]
        cut = np.ones(len(least), dtype=bool)
        cut[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
        first = np.flatnonzero(cut & ok)
        stops = np.flatnonzero(np.append(cut | ~ok, True))
        count = stops[np.searchsorted(stops, first, side="right")] - first
        m = least[first]
        bucket = (mix(m >> _POSITION_BITS) % U64(route.buckets)).astype(np.int64)
        found.append((first + low, count, (m & U64((1 << 24) - 1)).astype(np.int64) + low, bucket))
    return Runs(*(np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(4)))


def pack(arrays: list[np.ndarray], payload: bytes = b"") -> bytes:
    """int64 columns, as differences with their bytes in planes, and a string; compressed apart, since small blobs share one code."""
    raw = [struct.pack("<H", len(arrays))]
    for a in arrays:
        d = np.diff(a, prepend=0) if len(a) else a
        wide = bool(len(d) and (d.min() < -(1 << 31) or d.max() >= 1 << 31))
        kind = np.dtype("<i8" if wide else "<i4")
        raw += [struct.pack("<QB", len(d), wide), d.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()]
    small = zstandard.ZstdCompressor(level=LEVEL)
    return small.compress(b"".join(raw)) + (small.compress(payload) if payload else b"")


def unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    large = zstandard.ZstdDecompressor()
    first = large.decompressobj()
    raw = first.decompress(blob)
    if first.unused_data:  # stored levels of earlier versions have all in one
        raw += large.decompress(first.unused_data)
    (n,), at, arrays = struct.unpack_from("<H", raw), 2, []
    for _ in range(n):
        size, wide = struct.unpack_from("<QB", raw, at)
        kind = np.dtype("<i8" if wide else "<i4")
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at + 9).reshape(kind.itemsize, size)
        arrays.append(np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=np.int64))
        at += 9 + size * kind.itemsize
    return arrays, raw[at:]


@dataclass
class Pieces:
    """What travels: the document and its tag, the first window's place, the number of windows, the minimiser's place in the string, the string's place in ``buf``."""

    doc: np.ndarray
    tag: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    at: np.ndarray
    length: np.ndarray
    bucket: np.ndarray
    same: np.ndarray  # a hash of the string
    buf: np.ndarray


def joined(parts: list[Pieces]) -> Pieces:
    shift = np.cumsum([0, *(len(p.buf) for p in parts)])
    columns = {f: np.concatenate([getattr(p, f) for p in parts]) for f in Pieces.__dataclass_fields__ if f != "at"}
    return Pieces(**columns, at=np.concatenate([p.at + s for p, s in zip(parts, shift, strict=False)]))


def send(parts: list[Pieces], same_document: bool, span: int) -> Iterator[pa.RecordBatch]:
    """Judges repeated strings here and packs the rest by bucket.

    same_document: whether an earlier place in the same document counts as earlier. span: units of a window.
    """
    p = joined(parts)
    order = np.lexsort((p.start, p.tag, p.doc, p.same)) if same_document else np.lexsort((p.tag, p.doc, p.same))
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = p.same[order][1:] != p.same[order][:-1]
    first = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    later = (p.doc[order] > p.doc[first]) | (same_document & (p.doc[order] == p.doc[first]) & (p.start[order] > p.start[first]))
    settled = np.zeros(len(order), dtype=bool)
    settled[order] = later
    order = np.lexsort((p.start, p.doc, p.bucket))
    edges = np.flatnonzero(np.diff(p.bucket[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, dtype=int)
    names, blobs = [], []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        own = order[low:high]
        gone, own = own[settled[own]], own[~settled[own]]
        text = p.buf[ranges(p.at[own], p.length[own])].tobytes() if len(own) else b""
        names.append(int(p.bucket[order[low]]))
        blobs.append(pack([*(getattr(p, f)[own] for f in ("doc", "tag", "start", "count", "anchor")), p.length[own] - p.count[own], p.doc[gone], p.tag[gone], p.start[gone], p.start[gone] + p.count[gone] + span - 1], text))
        if sum(map(len, blobs[-64:])) > 4 << 20 or len(names) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
            names, blobs = [], []
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def received(blobs: Iterable[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, list[np.ndarray]]:
    """The pieces of one bucket (columns, with ``at`` in the buffer), their buffer, and the ranges that were settled before."""
    got = [unpack(b) for b in blobs]
    names = ("doc", "tag", "start", "count", "anchor", "length")
    columns = {f: np.concatenate([g[0][i] for g in got]) if got else np.zeros(0, dtype=np.int64) for i, f in enumerate(names)}
    columns["length"] += columns["count"]
    buf = np.frombuffer(b"".join(g[1] for g in got) + b" " * 8, dtype=np.uint8)
    columns["at"] = np.cumsum(columns["length"]) - columns["length"]
    return columns, buf, [np.concatenate([g[0][i] for g in got]) if got else np.zeros(0, dtype=np.int64) for i in range(6, 10)]


def window_ranges(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, span: int) -> list[np.ndarray]:
    """Windows (sorted by piece and place) as ranges of units: neighbours become one range."""
    if not len(doc):
        return [np.zeros(0, dtype=np.int64)] * 4
    lead = np.ones(len(doc), dtype=bool)
    lead[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1] + 1)
    a = np.flatnonzero(lead)
    b = np.append(a[1:], len(doc)) - 1
    return [doc[a], tag[a], place[a], place[b] + span]


RANGES = "part bigint, blob binary"


def by_group(columns: list[np.ndarray], groups: int) -> pa.Table:
    """Ranges (document, tag, start, end) packed by the group of their document."""
    part = np.mod(columns[0], groups)
    order = np.lexsort((columns[2], columns[0], part))
    columns, part = [c[order] for c in columns], part[order]
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, dtype=int)
    return pa.table({"part": pa.array(part[edges[:-1]], pa.int64()), "blob": pa.array([pack([c[a:b] for c in columns]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})


def sent(docs: DataFrame, pieces: Callable[[Chunk, Routing], Pieces], same_document: bool, span: int, route: Routing) -> DataFrame:
    """The pieces of all documents, packed by bucket: (bucket, blob)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, chunk in chunks(batches):
            held.append(pieces(chunk, route))
            size += len(chunk.buf)
            if size >= FLUSH_BYTES:
                yield from send(held, same_document, span)
                held, size = [], 0
        if held:
            yield from send(held, same_document, span)

    return narrow(docs, "doc_id", "text").mapInArrow(cut, "bucket bigint, blob binary")


def removed(docs: DataFrame, pieces: Callable[[Chunk, Routing], Pieces], judge: Callable[..., list[np.ndarray]], same_document: bool, span: int, route: Routing) -> DataFrame:
    """Ranges to remove, packed by document group; saved, so that the pieces leave the disk before the texts are shuffled."""

    def settle(table: pa.Table) -> pa.Table:
        columns, buf, before = received(table.column("blob").to_pylist())
        found = judge(columns, buf)
        return by_group([np.concatenate((a, b)) for a, b in zip(before, found, strict=True)], route.groups)

    return saved(sent(docs, pieces, same_document, span, route).groupBy("bucket").applyInArrow(settle, RANGES))


def apply_ranges(docs: DataFrame, found: DataFrame, groups: int, finish: Callable[[list[dict], pa.Table], pa.Table], schema, extra: tuple[str, ...] = ()) -> DataFrame:
    """Brings the ranges of each document to its whole text; ``finish`` gets a document's text and its merged ranges."""
    part = F.pmod(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), F.lit(groups)).cast("bigint")
    plain = narrow(docs, "doc_id", "text", *extra).withColumn("__part", part)
    schema_sent = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in plain.schema.fields])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = pa.array([None if t is None else small.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    left = plain.mapInArrow(squeeze, schema_sent)

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        got = [unpack(b)[0] for b in packed.column("blob").to_pylist()]
        columns = [np.concatenate([g[i] for g in got]) for i in range(4)] if got else [np.zeros(0, dtype=np.int64)] * 4
        order = np.lexsort((columns[2], columns[1], columns[0]))
        doc, tag, start, end = (c[order] for c in columns)
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for d, t, a, b in zip(doc.tolist(), tag.tolist(), start.tolist(), end.tolist(), strict=True):
            own = spans.setdefault((d, t), [])
            if own and a <= own[-1][1]:
                own[-1][1] = max(b, own[-1][1])
            else:
                own.append([a, b])
        large = zstandard.ZstdDecompressor()
        raw = pa.array([None if t is None else large.decompress(t) for t in texts.column("text").to_pylist()], pa.binary())
        texts = texts.set_column(texts.schema.get_field_index("text"), "text", raw)
        return finish(spans, texts.drop_columns(["__part"]))

    return left.groupBy("__part").cogroup(found.withColumnRenamed("part", "__part").groupBy("__part")).applyInArrow(run, schema)
