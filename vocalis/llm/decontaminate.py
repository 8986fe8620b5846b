"""Benchmark decontamination with SimHash over item-sized windows.

A window of words and a benchmark item get 64-bit SimHash fingerprints of their pairs of neighbouring words. Items are put in size classes; a class
has one window length and a stride, such that a copy of an item, wherever it starts, holds a whole window that begins at one of
the item's first ``stride`` words. Those windows of the items are indexed by four blocks of 16 bits: fingerprints within RADIUS
differ in at most RADIUS // 4 bits in some block, so that looking up each block's neighbours finds all of them. Items go in
blocks whose index has a bounded number of bytes, one pass over the documents each; what a shingle weighs is counted over the whole
benchmark first, so that the blocks don't change what matches.

RADIUS follows from THRESHOLD: a Dice similarity of 0.8 over five-word shingles is about one changed word of 25, which changes two
word pairs of 25; two such windows differ in 64 * acos(1 - 2 / 25) / pi = 8.2 bits on average, with a deviation of 2.7, and an item
has several windows. Fingerprints still miss copies that are cut at a document's edge or edited in bursts. Postings of rare shingles
complete them: a place with similarity THRESHOLD shares at least LEAST of the item's weight, so of any shingles with more than the rest
of the weight it holds one. Every pair of a document and an item that either way finds is then compared exactly at all its places.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.frames import narrow
from vocalis.llm.kernels import LOWER, NULL_ID, U64, Chunk, chunks, mix, prefix_hash, range_hash, ranges, word_hashes

RADIUS, BLOCKS = 11, 4
SHINGLE, THRESHOLD = 5, 0.8
#: With shared weight S, 2 S / (own + other) >= THRESHOLD and S <= other: S >= LEAST * own.
LEAST = THRESHOLD / (2 - THRESHOLD)
#: Weights are whole numbers in these units when places are compared, so that sums over ranges are exact.
UNIT = 1 << 32
#: Postings that are looked at together.
POSTINGS_AT_ONCE = 1 << 22
#: Bytes of the items' index in one pass over the documents; more items are more passes. It and nothing else is broadcast.
INDEX_BYTES = 96 << 20
#: A size class has so many bytes of offsets, an item's word so many in its shingles, postings and text.
CLASS_BYTES, WORD_BYTES = BLOCKS * 8 * 0x10001, 300


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER.tobytes()).split()


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    n = len(words) - width + 1
    return range_hash(prefix_hash(words), np.arange(n), np.arange(n) + width) if n > 0 else np.zeros(0, dtype=U64)


def stride_of(length: int) -> int:
    return max(1, length // 8)


def class_lengths(most: int) -> list[int]:
    """Window lengths, about a quarter apart."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


class Votes:
    """Running counts of the 64 hash bits over word pairs: the bits of any window's SimHash.

    The counts lie side by side in 64-bit numbers, 8 bits each, or 16 for windows of 256 words and more. They overflow into one
    another, but the difference of two running counts is exact as long as the window's own counts fit.
    """

    def __init__(self, hashes: np.ndarray):
        self.words = hashes
        pair = hashes.copy()
        pair[:-1] = mix(hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:])
        self.pairs = pair
        self.sums: dict[tuple[bool, int], np.ndarray] = {}

    def _running(self, single: bool, width: int) -> np.ndarray:
        if (single, width) not in self.sums:
            source = self.words if single else self.pairs
            rows = _LANES[width][source.view(np.uint8)].reshape(len(source), -1)
            out = np.zeros((len(source) + 1, rows.shape[1]), dtype=U64)
            for k in range(rows.shape[1]):
                np.cumsum(rows[:, k], out=out[1:, k])
            self.sums[single, width] = out
        return self.sums[single, width]

    def fingerprints(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the windows of ``length`` words from ``at``: their pairs of words, or the word of a window of one."""
        n = max(1, length - 1)
        width = 8 if n < 256 else 16
        running = self._running(length == 1, width)
        ones = (running[at + n] - running[at]).view(np.uint8 if width == 8 else np.uint16)
        return np.packbits(ones > n // 2).view(U64)


def _lanes(width: int) -> np.ndarray:
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return bits.astype(np.uint8 if width == 8 else np.uint16).view(U64)


_LANES = {8: _lanes(8), 16: _lanes(16)}


def neighbours(bits: int, radius: int) -> np.ndarray:
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(bits), r)]
    return np.asarray(masks, dtype=np.int64)


@dataclass
class SizeClass:
    length: int
    stride: int
    prints: np.ndarray  # of the items' windows
    item: np.ndarray
    offset: np.ndarray
    first: list[np.ndarray]  # per block: where each 16-bit value's entries begin
    entry: list[np.ndarray]


@dataclass
class Bag:
    """One item's shingles: distinct hashes in order, how often each occurs and what it weighs, the item's weight; words in a shingle."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    weight: int
    width: int


@dataclass
class Index:
    ids: list[int]
    words: list[list[bytes]]
    top: float  # the weight of a shingle that the item doesn't have
    classes: list[SizeClass]
    sizes: np.ndarray
    shingles: np.ndarray  # sorted hashes of all items' shingles
    flags: np.ndarray  # which low 16 bits occur among them
    bags: list[Bag | None]
    postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by width: rare shingles' hashes, where each one's items begin, items

    def known(self, hashes: np.ndarray) -> np.ndarray:
        out = self.flags[(hashes & U64(0xFFFF)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.shingles, hashes[maybe]), max(0, len(self.shingles) - 1))
        out[maybe] = self.shingles[at] == hashes[maybe] if len(self.shingles) else False
        return out

    def top_units(self, width: int) -> int:
        return round(self.top * UNIT) if width == SHINGLE else UNIT


def _rare(bag: Bag) -> np.ndarray:
    """The fewest of an item's shingles, the heaviest first, such that a place without any of them is under THRESHOLD."""
    order = np.argsort(-bag.units, kind="stable")
    upto = np.cumsum((bag.counts * bag.units)[order])
    return bag.hashes[order[: np.searchsorted(upto, (1 - LEAST) * bag.weight * (1 + 1e-9), side="right") + 1]]


def _postings(rare: dict[int, list[tuple[int, np.ndarray]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = {}
    for width, lists in rare.items():
        hashes = np.concatenate([h for _, h in lists])
        order = np.argsort(hashes, kind="stable")
        names, begin = np.unique(hashes[order], return_index=True)
        out[width] = (names, np.append(begin, len(hashes)), np.repeat([k for k, _ in lists], [len(h) for _, h in lists])[order])
    return out


def own_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of an item's shingles, in their order."""
    if not words:
        return np.zeros(0, dtype=U64)
    chunk = Chunk(np.zeros(1, dtype=np.int64), [b" ".join(words)])
    starts, ends, _ = chunk.words()
    return shingle_hashes(word_hashes(chunk.buf, starts, ends), min(SHINGLE, len(words)))


def spread_of(texts: list[str]) -> dict[int, int]:
    """How many of some items have each shingle, by its hash: what item_blocks() counts over a benchmark."""
    return Counter(h for t in texts for h in np.unique(own_hashes(words_of(t))).tolist())


def build(items: list[tuple[int, str]], spread: dict[int, int] | None = None, total: int | None = None) -> Index:
    """The index of a block of items. ``spread`` tells in how many of the benchmark's ``total`` items each of the block's shingles
    is: one that n items have weighs log(1 + total / n), one that an item doesn't have as much as one of a single item."""
    words = [words_of(text) for _, text in items]
    if spread is None or total is None:
        spread, total = spread_of([t for _, t in items]), len(items)
    lengths = [c for c in class_lengths(max(map(len, words), default=1))]
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if w:
            groups.setdefault(max(c for c in lengths if c + stride_of(c) - 1 <= len(w)), []).append(k)
    masks = neighbours(64 // BLOCKS, RADIUS // BLOCKS)
    classes, hashes, own = [], [], {}
    for length, members in sorted(groups.items()):
        prints, item, offset = [], [], []
        for k in members:
            chunk = Chunk(np.zeros(1, dtype=np.int64), [b" ".join(words[k])])
            starts, ends, _ = chunk.words()
            at = np.arange(stride_of(length))
            h = word_hashes(chunk.buf, starts, ends)
            hashes.append(shingle_hashes(h))
            own[k] = shingle_hashes(h, min(SHINGLE, len(h)))
            prints.append(Votes(h).fingerprints(at, length))
            item += [k] * len(at)
            offset += at.tolist()
        p = np.concatenate(prints)
        first, entry = [], []
        for b in range(BLOCKS):
            value = ((p >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)
            near = (value[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            entry.append((order // len(masks)).astype(np.int32))
            first.append(np.searchsorted(near[order], np.arange(0x10001)))
        classes.append(SizeClass(length, stride_of(length), p, np.asarray(item), np.asarray(offset), first, entry))
    flags = np.zeros(1 << 16, dtype=bool)
    known = np.unique(np.concatenate([*hashes, np.zeros(0, dtype=U64)]))
    flags[(known & U64(0xFFFF)).astype(np.int64)] = True
    bags: list[Bag | None] = [None] * len(items)
    rare: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, h in own.items():
        distinct, counts = np.unique(h, return_counts=True)
        width = min(SHINGLE, len(words[k]))
        units = np.asarray([round(log(1 + total / spread[x]) * UNIT) for x in distinct.tolist()], dtype=np.int64) if width == SHINGLE else np.full(1, UNIT)
        bags[k] = Bag(distinct, counts, units, int((counts * units).sum()), width)
        rare.setdefault(width, []).append((k, _rare(bags[k])))
    return Index([i for i, _ in items], words, log(1 + total), classes, np.asarray([len(w) for w in words]), known, flags, bags, _postings(rare))


def candidates(c: SizeClass, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (window, entry) whose fingerprints are within RADIUS."""
    windows, entries = [], []
    for b in range(BLOCKS):
        value = ((prints >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)
        low = c.first[b][value]
        n = c.first[b][value + 1] - low
        who = np.flatnonzero(n)
        while len(who):  # the k-th entry of every list at once
            e = c.entry[b][low[who]]
            near = np.bitwise_count(prints[who] ^ c.prints[e]) <= RADIUS
            windows.append(who[near])
            entries.append(e[near])
            low[who] += 1
            n[who] -= 1
            who = who[n[who] > 0]
    if not windows:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    pair = np.unique(np.stack((np.concatenate(windows), np.concatenate(entries))), axis=1)
    return pair[0], pair[1]


def similarity(index: Index, item: int, text: list[bytes]) -> float:
    """Weighted Dice similarity of the shingles, repeats counted."""
    bag = index.bags[item]
    if bag is None or not text:
        return 0.0
    if bag.width < SHINGLE:
        return float(index.words[item] == text)
    weight = dict(zip(bag.hashes.tolist(), bag.units.tolist(), strict=True))
    own, other = dict(zip(bag.hashes.tolist(), bag.counts.tolist(), strict=True)), Counter(own_hashes(text).tolist())
    shared = sum(min(n, other.get(h, 0)) * weight[h] for h, n in own.items())
    return 2 * shared / (bag.weight + sum(n * weight.get(h, index.top_units(SHINGLE)) for h, n in other.items()))


MATCHES = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double"


def _posted(index: Index, width: int, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, word) of each occurrence of an item's rare shingle inside a document."""
    names, begin, items = index.postings[width]
    at = np.flatnonzero(index.known(hashes)) if width == SHINGLE else np.arange(len(hashes))
    at = at[doc[at] == doc[at + width - 1]]
    k = np.minimum(np.searchsorted(names, hashes[at]), len(names) - 1)
    found = names[k] == hashes[at]
    at, k = at[found], k[found]
    n = begin[k + 1] - begin[k]
    part = np.cumsum(n) // POSTINGS_AT_ONCE
    for low, high in pairwise(np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()):
        word = np.repeat(at[low:high], n[low:high])
        yield doc[word], items[ranges(begin[k[low:high]], n[low:high])], word


def _places(index: Index, item: int, hashes: np.ndarray, bounds: tuple[int, int], near: tuple[int, int]) -> list[tuple[int, int]]:
    """(first word, end) of the places of one item from the words ``near``, none over another, the most similar first.

    A place is the item's number of words from anywhere, cut at the document's ``bounds``. All places are compared at once: the
    c-th last occurrence of a shingle that the item has c times tells from which first word on one more of it counts.
    """
    bag, size = index.bags[item], int(index.sizes[item])
    low, high = max(bounds[0], near[0] - size), min(bounds[1], near[1] + size)  # the words that a place can touch
    first, span = low - size + 1, high - low + size - 1  # places begin at first..high - 1
    n, inside = high - low - bag.width + 1, size - bag.width + 1
    if n <= 0:
        return []
    have = hashes[low : low + n]
    k = np.minimum(np.searchsorted(bag.hashes, have), len(bag.hashes) - 1)
    at = np.flatnonzero(bag.hashes[k] == have)
    if not len(at):
        return []
    place = np.arange(first, high)
    begin, end = np.maximum(place, low), np.minimum(place + size, high)
    whole = ((place >= low) | (low == bounds[0])) & ((place + size <= high) | (high == bounds[1]))  # only a document's edge cuts
    order = at[np.argsort(k[at], kind="stable")]
    kinds = k[order]
    c = bag.counts[kinds]
    before = np.arange(len(order)) - c
    same = (before >= 0) & (kinds[before] == kinds)
    since = np.maximum(np.where(same, order[before] + 1, -size), order - inside + 1) + low - first
    units = bag.units[kinds]
    gain = np.zeros(span + 1, dtype=np.int64)
    np.add.at(gain, since, units)
    np.subtract.at(gain, order + low - first + 1, units)
    shared = np.cumsum(gain[:-1])
    weigh = np.full(n, index.top_units(bag.width), dtype=np.int64)
    weigh[at] = bag.units[k[at]]
    upto = np.concatenate(([0], np.cumsum(weigh)))
    left = np.minimum(begin - low, n)
    other = upto[np.clip(end - bag.width + 1 - low, left, n)] - upto[left]
    likeness = 2 * shared / (bag.weight + other)
    good = np.flatnonzero(whole & (likeness >= THRESHOLD - 1e-9))
    taken, out = np.zeros(high - low, dtype=bool), []
    for g in good[np.lexsort((begin[good], -likeness[good]))].tolist():
        a, b = int(begin[g]), int(end[g])
        if not taken[a - low : b - low].any():
            taken[a - low : b - low] = True
            out.append((a, b))
    return out


def _matches(chunk: Chunk, index: Index) -> list[tuple]:
    """(document's place in the chunk, item id, first word, words, similarity)"""
    buf = LOWER[chunk.buf]
    starts, ends, doc = chunk.words()
    if not len(starts):
        return []
    hashes = word_hashes(buf, starts, ends)
    votes = Votes(hashes)
    of_width = {w: shingle_hashes(hashes, w) for w in {SHINGLE, *index.postings}}
    hits = np.concatenate(([0], np.cumsum(index.known(of_width[SHINGLE]))))
    first = np.searchsorted(doc, np.arange(len(chunk.ids)))
    last = np.append(first[1:], len(doc))
    near: dict[tuple[int, int], list[int]] = {}  # by document and item: the words around which it may be

    def add(d: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        pair, which = np.unique(d * len(index.ids) + item, return_inverse=True)
        least, most = np.full(len(pair), len(doc)), np.zeros(len(pair), dtype=np.int64)
        np.minimum.at(least, which, low)
        np.maximum.at(most, which, high)
        for p, a, b in zip(pair.tolist(), least.tolist(), most.tolist(), strict=True):
            span = near.setdefault(divmod(p, len(index.ids)), [a, b])
            span[0], span[1] = min(span[0], a), max(span[1], b)

    for c in index.classes:
        at = np.arange(0, max(0, len(doc) - c.length + 1))
        if c.stride > 1:
            at = at[(at - first[doc[at]]) % c.stride == 0]
        at = at[doc[at] == doc[at + c.length - 1]]
        for low in range(0, len(at), 1 << 17):
            window, entry = candidates(c, votes.fingerprints(at[low : low + (1 << 17)], c.length))
            # a place without a shingle of any item can't be similar to one
            word, item = at[window + low], c.item[entry]
            guess = word - c.offset[entry]
            some = np.diff(hits[np.clip(np.stack((guess - c.stride, guess + c.stride + index.sizes[item])), 0, len(hits) - 1)], axis=0)[0] > 0
            some |= index.sizes[item] < SHINGLE
            add(doc[word[some]], item[some], guess[some] - c.stride, (guess + c.stride + index.sizes[item])[some])
    for width in index.postings:
        for d, item, word in _posted(index, width, of_width[width], doc):
            add(d, item, word, word + width)
    out = []
    for (d, item), span in sorted(near.items()):
        width = index.bags[item].width
        for begin, end in _places(index, item, of_width[width], (int(first[d]), int(last[d])), (span[0], span[1])):
            text = [buf[starts[k] : ends[k]].tobytes() for k in range(begin, end)]
            out.append((d, index.ids[item], begin - int(first[d]), end - begin, similarity(index, item, text)))
    return out


def index_bytes(words: int) -> int:
    """What an item of so many words adds to an index: windows in all neighbouring places of each block, and its words."""
    windows = stride_of(words) if words else 0
    return windows * (24 + BLOCKS * 4 * len(neighbours(64 // BLOCKS, RADIUS // BLOCKS))) + words * WORD_BYTES


def counted_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, words, spread) of the items with a text; ``spread`` maps each of its shingles to how many items have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [np.unique(own_hashes(words_of(t))).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("rows"), pa.array(hashes, pa.list_(pa.int64()))], ["text", "rows", "hashes"])

    items = narrow(benchmark, "item_id", "text").where(F.col("text").isNotNull())
    texts = items.groupBy("text").agg(F.count("*").alias("rows")).mapInArrow(work, "text string, rows bigint, hashes array<bigint>")
    each = texts.select(F.md5("text").alias("key"), "rows", F.explode("hashes").alias("hash"))
    counted = each.join(each.groupBy("hash").agg(F.sum("rows").alias("n")), "hash").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("hash", "n"))).alias("spread"))
    words = F.size(F.split(F.trim("text"), r"\s+")).alias("words")
    return items.withColumn("key", F.md5("text")).join(counted, "key", "left").select("item_id", "text", words, "spread")


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], dict[int, int], int]]:
    """The benchmark in blocks, sorted by number of words and id, whose indexes stay within INDEX_BYTES, for build().

    A larger item is a block alone. Each block comes with the counts of its own shingles in the whole benchmark, and the number of items.
    """
    total = narrow(benchmark, "text").where(F.col("text").isNotNull()).count()
    block, spread, size, lengths = [], {}, 0, set()
    for r in counted_items(benchmark).orderBy("words", "item_id", "text").toLocalIterator():
        words = len(words_of(r.text))
        length = max(c for c in class_lengths(words + 1) if c <= max(1, words))
        more = index_bytes(words) + (CLASS_BYTES if length not in lengths else 0)
        if block and size + more > INDEX_BYTES:
            yield block, spread, total
            block, spread, size, lengths = [], {}, 0, set()
            more = index_bytes(words) + CLASS_BYTES
        block.append((r.item_id, r.text))
        spread |= {h % (1 << 64): n for h, n in (r.spread or {}).items()}
        lengths.add(length)
        size += more
    if block:
        yield block, spread, total


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every place of a benchmark item in a document: doc_id, item_id, start_word, n_words, similarity (at least 0.8).

    Words are lower-cased in A-Z and split at white space; shingles have five words, and an item of fewer words is one shingle.
    Null, empty and wordless texts match nothing, nor do null or wordless items. Repeated documents repeat their rows; a
    document that holds an item twice has a row for each place. A copy that the document's start or end cuts is compared as it
    is. Of overlapping places of one item the most similar stays, of equal ones the first.
    """
    spark, parts = docs.sparkSession, []
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(build(*block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            for _, chunk in chunks(batches, 1 << 20):
                rows = [(None if chunk.ids[m[0]] == NULL_ID else int(chunk.ids[m[0]]), *m[1:]) for m in _matches(chunk, shared.value)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        parts.append(narrow(docs, "doc_id", "text").mapInArrow(run, MATCHES))
    out = spark.createDataFrame([], MATCHES) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, in one pass without a shuffle for each block of items."""
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(build(*block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, chunk in chunks(batches, 1 << 20):
                keep = np.ones(len(chunk.ids), dtype=bool)
                keep[[m[0] for m in _matches(chunk, shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
