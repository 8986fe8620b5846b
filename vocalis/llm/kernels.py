"""Vectorised byte and word kernels that the Python-side operators share.

All of them work on one chunk: a few megabytes of whole documents, joined by a newline.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
NULL_ID = -(1 << 63)
#: Bytes that separate words: U+0020 and U+0009 to U+000D. They never occur inside a UTF-8 sequence.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        _tables[size] = (out[0], out[1])
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; it changes x, which must be a fresh array."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums: range_hash() gets any range's hash from them."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U64))


class Chunk:
    """Whole documents in one buffer: ids, bytes, and where each document starts and ends."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's first byte, end and document (its position in the chunk)."""
        inside = IS_WORD[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(self.ends, starts, side="right")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(buf), starts, ends)


def chunks(batches: Iterable[pa.RecordBatch], limit: int = 2 << 20, most: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Cuts Arrow batches with the columns (doc_id, text) into chunks of about ``limit`` bytes and at most ``most`` rows; a longer document is a chunk alone.

    A null text is an empty one here, and a null id reads as NULL_ID, the smallest.
    """
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        raw = [t or b"" for t in text.to_pylist()]
        ids = np.asarray(batch.column("doc_id").fill_null(NULL_ID)).astype(np.int64)
        first, size = 0, 0
        for i, t in enumerate(raw):
            if size and (size + len(t) > limit or i - first >= most):
                yield batch.slice(first, i - first), Chunk(ids[first:i], raw[first:i])
                first, size = i, 0
            size += len(t) + 1
        if first < len(raw):
            yield batch.slice(first), Chunk(ids[first:], raw[first:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of ``width`` values."""
    if len(x) < width:
        return x[:0]
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(x) - width + 1], m[width - have :])
    return m


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number: a view, without a copy."""
    return np.lib.stride_tricks.as_strided(buf[:8].view("<u8") if len(buf) >= 8 else np.zeros(0, dtype="<u8"), shape=(max(0, len(buf) - 7),), strides=(1,))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] to starts[i] + lengths[i] - 1 of each i, in a row."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
