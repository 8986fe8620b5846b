"""Substring deduplication over words by super-k-mer partitioning.

Windows of ``k`` consecutive words travel as super-k-mers (see shards.py) to their minimiser's bucket. There the words become
exact dictionary codes, the windows are sorted, and each group of equal windows is counted: all but the first place are repeats.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vocalis.llm import shards
from vocalis.llm.kernels import NULL_ID, U64, Chunk, mix, prefix_hash, range_hash, ranges, word_hashes

K, M = 20, 3


def tags(chunk: Chunk) -> np.ndarray:
    """Keeps apart different texts that share an id."""
    return np.fromiter((zlib.crc32(t) for t in chunk.texts), dtype=np.int64, count=len(chunk.texts))


def _mmers(h: np.ndarray) -> np.ndarray:
    out = h[: max(0, len(h) - M + 1)].copy()
    for i in range(1, M):
        out = out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - M + 1 + i]
    return mix(out)


def word_mmers(chunk: Chunk) -> list[np.ndarray]:
    starts, ends, _ = chunk.words()
    return [_mmers(word_hashes(chunk.buf, starts, ends))]


def word_pieces(chunk: Chunk, route: shards.Routing) -> shards.Pieces:
    starts, ends, doc = chunk.words()
    h = word_hashes(chunk.buf, starts, ends)
    valid = doc[: max(0, len(doc) - K + 1)] == doc[K - 1 :]
    runs = shards.super_kmers(_mmers(h), valid, K - M + 1, route)
    lengths = ends - starts + 1  # each word with one space
    offsets = np.cumsum(lengths) - lengths
    text = np.full(int(lengths.sum()), 32, dtype=np.uint8)
    text[ranges(offsets, ends - starts)] = chunk.buf[ranges(starts, ends - starts)]
    last = runs.first + runs.count + K - 2
    first_word = np.searchsorted(doc, np.arange(len(chunk.ids)))
    owner = doc[runs.first]
    sums = prefix_hash(h)
    return shards.Pieces(chunk.ids[owner], tags(chunk)[owner], runs.first - first_word[owner], runs.count, runs.anchor - runs.first, offsets[runs.first], offsets[last] + lengths[last] - offsets[runs.first], runs.bucket, range_hash(sums, runs.first, last + 1), text)


def repeats(p: dict[str, np.ndarray], buf: np.ndarray) -> list[np.ndarray]:
    """Exact: windows are sorted by a hash of their words' codes, and each is compared word by word with the first of its group."""
    if not len(p["doc"]):
        return [np.zeros(0, dtype=np.int64)] * 4
    ends = np.flatnonzero(buf[: int(p["length"].sum())] == 32) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf.tobytes())])
    code = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    sums = prefix_hash(mix(code.astype(U64)))
    first_word = np.searchsorted(offsets, p["at"])
    at = ranges(first_word, p["count"])
    piece = np.repeat(np.arange(len(p["doc"])), p["count"])
    place = p["start"][piece] + (at - first_word[piece])
    h = range_hash(sums, at, at + K)
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    inside = np.zeros(len(order), dtype=bool)
    inside[1:] |= equal
    inside[:-1] |= equal
    w = order[inside]  # windows whose hash another has
    doc = p["doc"][piece[w]]
    tag = p["tag"][piece[w]]
    w = w[np.lexsort((tag, place[w], doc, h[w]))]
    later = np.zeros(len(h), dtype=bool)
    todo = w
    while len(todo):  # a second round is only for different windows of one hash
        lead = np.ones(len(todo), dtype=bool)
        lead[1:] = h[todo][1:] != h[todo][:-1]
        first = todo[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        same = np.ones(len(todo), dtype=bool)
        for i in range(K):
            same &= code[at[todo] + i] == code[at[first] + i]
        d, f = p["doc"][piece[todo]], p["doc"][piece[first]]
        later[todo] = same & ((d > f) | (d == f) & (place[todo] > place[first]))
        todo = todo[~same]
    gone = np.flatnonzero(later)
    return shards.window_ranges(p["doc"][piece[gone]], p["tag"][piece[gone]], place[gone], K)


DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def repeated_words(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text: the words left, joined by a space.

    A word goes if a window of 20 words that covers it has the same words as one that starts earlier: in a document of smaller
    id, or earlier in the same document. A null or empty text has no words; a text shorter than a window keeps all of them. A
    null id counts as the smallest. Rows that repeat id and text count as one document; different texts of one id are judged
    apart, the earlier start first. An empty table gives an empty result.
    """
    route = shards.routing(docs, word_mmers)
    found = shards.removed(docs, word_pieces, repeats, True, K, route)

    def finish(spans: dict, texts: pa.Table) -> pa.Table:
        rows = []
        for key, text in zip(texts.column(0).to_pylist(), texts.column(1).cast(pa.binary()).to_pylist(), strict=True):
            raw = text or b""
            words = raw.split()
            kept, at = [], 0
            for a, b in spans.get((NULL_ID if key is None else key, zlib.crc32(raw)), ()):
                kept += words[at:a]
                at = b
            kept += words[at:]
            left = b" ".join(kept)
            rows.append((key, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if keep_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"), kinds, strict=True))})

    return shards.apply_ranges(docs, found, route.groups, finish, DIGEST)
