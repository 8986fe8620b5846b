"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a value between them that differs from either in at most half of r. So every
distinct fingerprint emits all values in its ball of half the radius, and fingerprints that emit one value meet there.

A ball of radius 2 has 2,081 values. They are dealt by their leading bits, and those of one fingerprint that share them travel as
one row: the fingerprint and the bits to flip among the leading ones; the task that gets it emits the values themselves. Prefixes
that hold many fingerprints take more leading bits, and a task that still has too many values to emit takes them bit by bit, so
that its memory has a bound. Where fingerprints meet, each is linked to the least of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.components import connected, contract
from vocalis.llm.frames import narrow, saved, shuffle_partitions

BITS, SEED = 64, 42
#: Values that a bucket of leading bits holds on average, that a group of buckets may hold, and that a task emits at once.
BUCKET_VALUES, SLOT_VALUES, TASK_VALUES = 1 << 19, 1 << 22, 1 << 22
#: Leading bits that a crowded prefix takes more; there can't be more such prefixes than HOT_MOST.
DEEPER, HOT_MOST = 20, 4096
#: Shingles that are hashed at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, n: int = 4) -> int:
    """The SimHash of a text's n-word shingles, repeats included: a bit is 1 if it is set in over half of their XXH64."""
    buf = b" ".join(text.lower().split())
    if not buf:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(buf, dtype=np.uint8) == 32), len(buf))
    starts = np.append(0, ends[:-1] + 1)
    starts, ends = (starts[: 1 - n or None], ends[n - 1 :]) if len(ends) >= n else (starts[:1], ends[-1:])
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        a, b = starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(buf[i:j], SEED) for i, j in zip(a, b, strict=True)), dtype="<u8", count=len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed number; a text without words, or null, has 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", n) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(work, "doc_id bigint, fp bigint")


@cache
def flips(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of so many bits with at most ``most`` ones, and their ones."""
    out = [(sum(1 << i for i in chosen), k) for k in range(min(bits, most) + 1) for chosen in combinations(range(bits), k)]
    return np.array([m for m, _ in out], dtype=np.uint64), np.array([k for _, k in out], dtype=np.int8)


def _balls(bits: int, most: int) -> int:
    return sum(comb(bits, k) for k in range(min(bits, most) + 1))


def collisions(fps: np.ndarray, flip: np.ndarray, free: int, radius: int, limit: int = TASK_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that meet in a value, each to the least of them: two arrays.

    Row i emits the values that differ from ``fps[i] ^ flip[i]`` in any of the ``free`` low bits, as far as its ball reaches. For an
    odd radius one ball is larger by one: fingerprints meet only with one that is within the smaller.
    """
    ball, inner = (radius + 1) // 2, radius // 2
    none = np.zeros(0, dtype=np.uint64)
    spent = np.bitwise_count(flip).astype(np.int8)
    emits = np.array([_balls(free, ball - int(k)) for k in range(ball + 1)])[spent] if len(fps) else none
    if len(fps) < 2:
        return none, none
    if emits.sum() > limit and free and len(fps) > 1:  # half of the values at a time: by the next bit
        bit, out = np.uint64(1 << (free - 1)), []
        one = ((fps ^ flip) & bit) != 0
        for side in (one, ~one):
            over = ~side & (spent < ball)
            out.append(collisions(np.concatenate((fps[side], fps[over])), np.concatenate((flip[side], flip[over] ^ bit)), free - 1, radius, limit))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
    values, owner, far = [], [], []
    for k in range(ball + 1):
        rows = np.flatnonzero(spent == k)
        if len(rows):
            masks, ones = flips(free, ball - k)
            values.append(((fps ^ flip)[rows][:, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(rows, len(masks)))
            far.append(np.tile(ones + np.int8(k), len(rows)))
    values, owner, far = np.concatenate(values), np.concatenate(owner), np.concatenate(far)
    ordered = np.sort(values)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(met):
        return none, none
    marks = np.zeros(1 << 20, dtype=bool)  # most values are met by nobody: a table of hashes tells that without a search
    mark = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    marks[mark(met)] = True
    hit = np.flatnonzero(marks[mark(values)])
    place = np.minimum(np.searchsorted(met, values[hit]), len(met) - 1)
    hit, place = hit[met[place] == values[hit]], place[met[place] == values[hit]]
    fp, within = fps[owner[hit]], far[hit] <= inner
    least = np.full(len(met), np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, place[within], fp[within])
    anchored = np.zeros(len(met), dtype=bool)
    anchored[place[within]] = True
    keep = anchored[place] & (fp != least[place])
    a, b = least[place[keep]], fp[keep]
    a, b = np.unique(np.stack((a, b)), axis=1) if len(a) else (none, none)
    near = np.bitwise_count(a ^ b) <= radius
    return a[near], b[near]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """From the distinct fingerprints (fp): links (a, b) within the radius that connect what chains of such links connect.

    Equal links may come from several tasks. ``distinct`` is read several times.
    """
    if not 0 < radius <= 8:
        raise ValueError("radius must be 1 to 8")
    ball = (radius + 1) // 2
    n = distinct.count()
    every = n * _balls(BITS, ball)
    lead = min(max(1, round(log2(max(2, every / BUCKET_VALUES)))), 28)
    prefix = lambda c, bits: F.shiftrightunsigned(c, BITS - bits)
    signed = lambda m, up: [int(x) for x in (m << np.uint64(up)).view(np.int64)]
    crowded = max(SLOT_VALUES // _balls(BITS - lead, ball), n // HOT_MOST)
    hot = [r.p for r in distinct.groupBy(prefix(F.col("fp"), lead).alias("p")).agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("p").collect()]  # fewer than HOT_MOST, by arithmetic
    flipped = lambda masks: F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))
    rows = distinct.withColumn("flip", flipped(signed(flips(lead, ball)[0], BITS - lead)))
    at = prefix(F.col("fp").bitwiseXOR(F.col("flip")), lead)
    parts = [rows.where(~at.isin(hot)).withColumn("lead", F.lit(lead)) if hot else rows.withColumn("lead", F.lit(lead))]
    if hot:
        more = rows.where(at.isin(hot)).withColumn("more", flipped(signed(flips(DEEPER, ball)[0], BITS - lead - DEEPER)))
        more = more.withColumn("flip", F.col("flip").bitwiseOR(F.col("more"))).where(F.bit_count("flip") <= ball)
        parts.append(more.select("fp", "flip", F.lit(lead + DEEPER).alias("lead")))
    slots = max(4 * shuffle_partitions(distinct.sparkSession), every // SLOT_VALUES)
    dealt = []
    for part, bits in zip(parts, (lead, lead + DEEPER), strict=False):
        slot = F.pmod(F.xxhash64(prefix(F.col("fp").bitwiseXOR(F.col("flip")), bits), "lead"), F.lit(slots))
        dealt.append(part.select("fp", "flip", "lead", slot.alias("slot")))

    def work(table: pa.Table) -> pa.Table:
        fp, flip, bits = (np.asarray(table.column(c)) for c in ("fp", "flip", "lead"))
        a, b = [], []
        for k in np.unique(bits):
            own = bits == k
            for out, x in zip((a, b), collisions(fp[own].view(np.uint64), flip[own].view(np.uint64), BITS - int(k), radius), strict=True):
                out.append(x.view(np.int64))
        node, least = contract(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": pa.array(node), "b": pa.array(least)})

    return (dealt[0].unionByName(dealt[1]) if hot else dealt[0]).groupBy("slot").applyInArrow(work, "a bigint, b bigint")


def components(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits) and component_id, the least doc_id that links reach.

    Fingerprints link at ``radius`` or fewer differing bits. A text without words, or null, has the fingerprint 0 and is linked like
    any other. Rows with equal ids stay rows; a null id takes part in links but never names a component, unless it is alone there.
    An empty table gives an empty result; other columns are ignored.
    """
    prints = saved(fingerprints(docs, n))
    first = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = connected(links(first.select("fp"), radius))
    rooted = first.join(joined, first["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
