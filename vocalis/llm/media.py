"""TIFF columns: a walker over image directories that emits one row per page, and a writer for round trips.

Reads both byte orders; samples of 1, 2, 4, 8 and 16 bits, side by side or in planes; strips and tiles, without compression or
with PackBits, LZW or deflate, with or without the horizontal predictor. Nothing is allocated by what a file claims: cells are
decoded up to the size that the directory asks for, and a page whose cells fall short of it is an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vocalis.llm.frames import narrow

# Fixed values of the TIFF 6.0 format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_FORMATS = {1: "B", 3: "H", 4: "I"}


#: The most bytes of a page's samples; a larger page is an error.
MOST_BYTES = 1 << 30
#: What a broken file can raise while it is walked.
BROKEN = (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # (height, width, samples), uint8, or uint16 for 16 bits


def unpack_bits(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out[:most])


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and data[end] != data[end - 1]:
            end += 1
        out += bytes((end - i - 1,)) + data[i:end]
        i = end
    return bytes(out)


def unpack_lzw(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends, and widths grow one code early."""
    out, table, width, previous = bytearray(), [], 9, b""
    bits = held = 0
    for byte in data:
        bits, held = ((bits << 8) | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = (bits >> held) & ((1 << width) - 1)
        if code == 257 or len(out) >= most:
            break
        if code == 256:
            table, width, previous = [bytes((b,)) for b in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data doesn't begin with a clear code")
        if code > len(table) or code == len(table) and not previous:
            raise ValueError("an LZW code names no entry")
        entry = table[code] if code < len(table) else previous + previous[:1]
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
        out += entry
        previous = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out[:most])


def pack_lzw(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table: dict[bytes, int] = {bytes((b,)): b for b in range(256)}
    following, prefix = 258, b""
    width = 9
    for i in range(len(data)):
        one = data[i : i + 1]
        if prefix + one in table:
            prefix += one
            continue
        codes.append((table[prefix], width))
        table[prefix + one] = following
        following += 1
        width = max(9, following.bit_length())
        prefix = one
        if following == 4094:
            codes.append((table[prefix], width))
            codes.append((256, width))
            table, following, prefix, width = {bytes((b,)): b for b in range(256)}, 258, b"", 9
    if prefix:
        codes.append((table[prefix], width))
        width = min(12, max(9, (following + 1).bit_length()))
    codes.append((257, width))
    out, held, bits = bytearray(), 0, 0
    for code, n in codes:
        bits, held = (bits << n) | code, held + n
        while held >= 8:
            held -= 8
            out.append((bits >> held) & 255)
            bits &= (1 << held) - 1
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def _unpack(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data[:most]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == PACKBITS:
        return unpack_bits(data, most)
    if compression == LZW:
        return unpack_lzw(data, most)
    raise ValueError(f"compression {compression} isn't supported")


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: lambda: data, DEFLATE: lambda: zlib.compress(data, 1), PACKBITS: lambda: pack_bits(data), LZW: lambda: pack_lzw(data)}[compression]()


def _tags(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind in TYPE_FORMATS:
            form = f"{order}{count}{TYPE_FORMATS[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            tags[tag] = struct.unpack_from(form, data, place)
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _cell(raw: bytes, rows: int, width: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """A strip or tile as (rows, width, samples)."""
    if bits < 8:
        flat = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1), axis=1)[:, : width * samples * bits]
        cell = flat.reshape(rows, width * samples, bits) @ (1 << np.arange(bits - 1, -1, -1))
        cell = cell.astype(np.uint8).reshape(rows, width, samples)
    else:
        cell = np.frombuffer(raw, dtype=np.uint8 if bits == 8 else f"{order}u2").reshape(rows, width, samples).astype(np.uint8 if bits == 8 else np.uint16)
    return np.cumsum(cell, axis=1, dtype=cell.dtype) if predictor == 2 else cell


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str, number: int) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (1, 2, 4, 8, 16) or any(b != bits for b in tags.get(BITS, ())) or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError(f"samples of {tags.get(BITS)} bits with predictor {predictor} aren't supported")
    tiled, apart = TILE_OFFSETS in tags, one(PLANAR, 1) == 2 and samples > 1
    cell_w, cell_h = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if min(width, height, samples, cell_w, cell_h) < 1:
        raise ValueError("a side of the image or of its cells is missing or 0")
    if width * height * samples * (2 if bits == 16 else 1) > MOST_BYTES:
        raise ValueError(f"the page has more than {MOST_BYTES} bytes of samples")
    across, down, planes, inside = -(-width // cell_w), -(-height // cell_h), samples if apart else 1, 1 if apart else samples
    places = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    if len(places) != across * down * planes:
        raise ValueError(f"{len(places)} cells where {across * down * planes} belong")
    cells = []
    for k, (place, size) in enumerate(places):
        y = k // across % down * cell_h
        rows = cell_h if tiled else min(cell_h, height - y)
        want = rows * (-(-cell_w * inside * bits // 8))
        raw = _unpack(data[place : place + size], compression, want)
        if len(raw) < want:
            raise ValueError(f"cell {k} has {len(raw)} of {want} bytes")
        cells.append((y, k % across * cell_w, k // (across * down), _cell(raw, rows, cell_w, inside, bits, order, predictor)))
    pixels = np.zeros((height, width, samples), dtype=np.uint16 if bits == 16 else np.uint8)
    for y, x, plane, cell in cells:
        part = pixels[y : y + cell.shape[0], x : x + cell_w, plane : plane + 1] if apart else pixels[y : y + cell.shape[0], x : x + cell_w]
        part[...] = cell[: height - y, : width - x]
    return Page(number, width, height, samples, bits, compression, predictor, pixels)


def pages(data: bytes) -> Iterator[Page]:
    """Walks the chain of image directories. What is broken, claims more than there is or isn't supported raises one of BROKEN."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("this is no TIFF")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        tags, following = _tags(data, at, order)
        yield _page(data, tags, order, len(seen) - 1)
        at = following


def _raw(cell: np.ndarray, bits: int, order: str, predictor: int) -> bytes:
    if predictor == 2:
        cell = np.concatenate((cell[:, :1], cell[:, 1:] - cell[:, :-1]), axis=1)
    if bits < 8:
        flat = cell.reshape(len(cell), -1, 1) >> np.arange(bits - 1, -1, -1) & 1
        return np.packbits(flat.reshape(len(cell), -1).astype(np.uint8), axis=1).tobytes()
    return cell.astype(np.uint8 if bits == 8 else f"{order}u2").tobytes()


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: int | None = None, order: str = "<", bits: int = 8, apart: bool = False) -> bytes:
    """A TIFF with one page for each (height, width, samples) array; tiles of tile x tile pixels if ``tile`` is set, planes if ``apart``."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        cells = []
        for plane in np.split(image, samples, axis=2) if apart else [image]:
            for y in range(0, height, tile or rows_per_strip):
                for x in range(0, width, tile or width):
                    cell = plane[y : y + (tile or rows_per_strip), x : x + (tile or width)]
                    if tile:
                        cell = np.pad(cell, ((0, tile - cell.shape[0]), (0, tile - cell.shape[1]), (0, 0)))
                    cells.append(_pack(_raw(cell, bits, order, predictor), compression))
        places = []
        for c in cells:
            places.append(len(out))
            out += c + b"\0" * (len(c) % 2)
        tags = {WIDTH: [width], LENGTH: [height], BITS: [bits] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [2 if apart else 1], PREDICTOR: [predictor]}
        sizes = [len(c) for c in cells]
        tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: places, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: places, ROWS_PER_STRIP: [rows_per_strip], STRIP_BYTES: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            long = tag in (STRIP_OFFSETS, STRIP_BYTES, TILE_OFFSETS, TILE_BYTES, WIDTH, LENGTH, ROWS_PER_STRIP)
            raw = struct.pack(f"{order}{len(values)}{'I' if long else 'H'}", *values)
            if len(raw) > 4:
                raw, place = struct.pack(f"{order}I", len(out)), raw
                out += place + b"\0" * (len(place) % 2)
            entries += struct.pack(f"{order}HHI", tag, 4 if long else 3, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


PAGE_SCHEMA = "media_id bigint, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def read_pages(media: DataFrame, id_column: str = "media_id", data_column: str = "data") -> DataFrame:
    """One row per page of each TIFF in a binary column; samples of 16 bits are little-endian in ``pixels``.

    A null, empty or broken file gives one row with an error and no pixels, after those of the pages before the break.
    """
    names = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
    kinds = (pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = pages(data or b"")
                while True:
                    try:
                        p = next(found)
                        row = (key, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), None)
                    except StopIteration:
                        break
                    except BROKEN as e:
                        row = (key, *[None] * 8, f"{type(e).__name__}: {e}")
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return narrow(media, id_column, data_column).mapInArrow(run, PAGE_SCHEMA)


ROW_BYTES, PAGE_ROWS = 192, 512


def encode_text(text: bytes) -> tuple[bytes, int]:
    """Text as a TIFF of 64 RGB pixels a row and PAGE_ROWS rows a page, padded with spaces; also the payload's size."""
    size = max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES
    image = np.frombuffer(text.ljust(size, b" "), dtype=np.uint8).reshape(-1, 64, 3)
    return write([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], predictor=1), size


def feature(payload: np.ndarray) -> str:
    """Mean, 16-bin histogram as shares in 1/255 and a mean hash over an 8 x 8 grid; from the samples alone."""
    histogram = np.bincount(payload >> 4, minlength=16) * 255 // len(payload)
    cells = np.add.reduceat(payload.astype(np.int64), np.arange(64) * len(payload) // 64) / (np.diff(np.append(np.arange(64) * len(payload) // 64, len(payload))))
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"{int(payload.sum(dtype=np.int64)) * 1000 // len(payload)}:{histogram.astype(np.uint8).tobytes().hex()}:{bits}"


DIGEST_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages int"


def text_media(docs: DataFrame) -> DataFrame:
    """Stores each whole text as a TIFF, reads the stored pages back and returns digests of what was read, one row per document.

    A null or empty text is one row of 64 pixels of spaces. Equal texts get equal values; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                stored, _ = encode_text(text)
                parts = [p.pixels.reshape(-1) for p in pages(stored)]
                read = np.concatenate(parts) if len(parts) > 1 else parts[0]
                raw = read.tobytes()
                rows.append((key, len(text), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(read), len(parts)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])

    return narrow(docs, "doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)
