"""Language identification by nearest centroid.

A text becomes a unit TF-IDF vector of letter n-grams (pairs and triples of bytes of the lower-cased text, hashed into DIMS
columns). Each language has several centroids, found by spherical k-means; the nearest centroid by cosine names the language.
A text that lies much farther from every centroid than held-out training texts of its length is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm.frames import narrow
from vocalis.llm.kernels import LOWER, Chunk, chunks

UNDETERMINED = "und"
DIMS = 4096
#: Rejection: a score so many standard deviations (of its logarithm) below that of held-out training texts of about that length.
REJECT, LEAST_SPREAD, MIN_ROWS, LENGTHS = 7.0, 0.1, 40, 32
#: Documents whose dense counts are held at once, and languages that a model can have.
ROWS, MAX_LANGUAGES = 512, 2000
_LETTER = re.compile(r"[^\W\d_]")
#: Letters and all bytes of longer UTF-8 sequences stay; everything else reads as a space.
_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_SPACE = np.full(1, 32, dtype=np.uint8)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # each centroid's language
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    floor: np.ndarray  # least accepted score by log2 of the number of distinct n-grams


def counts(chunk: Chunk) -> np.ndarray:
    """The n-gram counts of each document, over its whole text."""
    buf = _FOLD[chunk.buf]
    late = np.flatnonzero(chunk.buf[1:] < 0x9F) + 1  # capital Latin-1 letters: C3 80 to C3 9E
    late = late[(chunk.buf[late] >= 0x80) & (chunk.buf[late - 1] == 0xC3)]
    buf[late] += 0x20
    # each text stands between two spaces: the one before it is its own, and no n-gram reaches into a neighbour
    buf = np.concatenate((_SPACE, buf, _SPACE))
    doc = np.repeat(np.arange(len(chunk.ids), dtype=np.int64), chunk.ends - chunk.starts + 1)
    a, b, c = (buf[i : len(buf) - 2 + i].astype(np.uint32) for i in range(3))
    two, three = (a << 8) | b, (a << 16) | (b << 8) | c
    n = len(chunk.ids)
    out = np.zeros((n, DIMS), dtype=np.float32)
    for gram, keep in ((two, (a != 32) | (b != 32)), (three, b != 32)):
        column = (gram * np.uint32(2654435761)) >> np.uint32(20)
        at = doc[: len(gram)][keep] * DIMS + column[keep]
        out += np.bincount(at, minlength=n * DIMS).reshape(n, DIMS)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def length_class(tf: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + (tf > 0).sum(axis=1)).astype(int), LENGTHS - 1)


def has_letter(text: str) -> bool:
    """Digits and numerals of any kind are no letters, unlike what ``\\w`` says of some."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _centroids(x: np.ndarray, lang: np.ndarray, languages: int, clusters: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of each language's vectors. Deterministic: the first centroid is the mean, each next the text farthest from those before."""
    owner, centroids = [], []
    for i in range(languages):
        own = x[lang == i]
        if not len(own):
            continue
        c = own.mean(axis=0, keepdims=True)
        while len(c) < min(clusters, len(own)):
            c = np.concatenate([c, own[[(own @ c.T).max(axis=1).argmin()]]])
        for _ in range(rounds):
            near = (own @ c.T).argmax(axis=1)
            c = np.stack([own[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        owner += [i] * len(c)
        centroids.append(c)
    return np.asarray(owner, dtype=int), np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, DIMS), dtype=np.float32)


def _floors(score: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By length class: the mean of the logarithm of held-out scores less REJECT standard deviations, over a window of classes with enough rows."""
    floor = np.zeros(LENGTHS, dtype=np.float32)
    for k in range(LENGTHS if len(score) else 0):
        reach = next((w for w in range(LENGTHS) if (np.abs(size - k) <= w).sum() >= MIN_ROWS), LENGTHS)
        own = np.log(np.maximum(score[np.abs(size - k) <= reach], 1e-6))
        floor[k] = np.exp(own.mean() - REJECT * max(own.std(), LEAST_SPREAD))
    return floor


def train(langs: list[str], tf: np.ndarray, clusters: int = 3, rounds: int = 10) -> Model:
    """langs and n-gram counts of each training text.

    The rejection level comes from held-out scores: each half of the rows (every other one of each language) is scored by the
    centroids of the other half.
    """
    languages = sorted(set(langs))
    lang = np.asarray([languages.index(x) for x in langs], dtype=int)
    idf = np.log((1 + len(langs)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 1
    x = vectors(tf, idf)
    owner, centroids = _centroids(x, lang, len(languages), clusters, rounds)
    half = np.zeros(len(langs), dtype=int)
    for i in range(len(languages)):
        half[lang == i] = np.arange((lang == i).sum()) % 2
    best = np.zeros(len(langs))
    for h in (0, 1):
        _, c = _centroids(x[half != h], lang[half != h], len(languages), clusters, rounds)
        if len(c) and (half == h).any():
            best[half == h] = (x[half == h] @ c.T).max(axis=1)
    seen = best > 0
    return Model(languages, owner, centroids, idf, _floors(best[seen], length_class(tf)[seen]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _shares(labelled: DataFrame, rows_per_language: int) -> dict[str, float]:
    """The share of each language's rows that makes up rows_per_language, from counts: one row a language."""
    counted = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r.lang: min(1.0, rows_per_language / r["count"]) for r in counted}


def fit(docs: DataFrame, rows_per_language: int = 400, clusters: int = 3) -> Model:
    """Trains on whole texts of a bounded sample of the labelled documents, about rows_per_language of each language.

    The sample holds the documents whose hash of the id is low enough for their language's share; it is drawn while the table is
    scanned, and only n-gram counts (DIMS numbers a row, however long the text) reach the driver. Held-out documents, and those
    without lang or text, are not used. More than MAX_LANGUAGES languages raise ValueError.
    """
    labelled = narrow(docs, "doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    shares = _shares(labelled, rows_per_language)
    if not shares:
        return train([], np.zeros((0, DIMS), dtype=np.float32), clusters)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for share in sorted(set(shares.values())):  # one condition for all languages with the same share
        wanted |= F.col("lang").isin([k for k, v in shares.items() if v == share]) & (draw < share)
    sample = narrow(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in chunks(batches, most=ROWS):
            tf = counts(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([zlib.compress(row.tobytes(), 1) for row in tf], pa.binary())], ["doc_id", "lang", "tf"])

    rows = sorted(sample.mapInArrow(run, "doc_id bigint, lang string, tf binary").collect(), key=lambda r: (r.lang, r.doc_id, bytes(r.tf)))
    tf = np.stack([np.frombuffer(zlib.decompress(r.tf), dtype=np.float32) for r in rows]) if rows else np.zeros((0, DIMS), dtype=np.float32)
    return train([r.lang for r in rows], tf, clusters)


SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def _score(chunk: Chunk, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    tf = counts(chunk)
    letters = np.fromiter((has_letter(t.decode("utf-8", "replace")) for t in chunk.texts), dtype=bool, count=len(chunk.ids))
    if not len(model.languages):
        return [UNDETERMINED] * len(letters), np.zeros(len(letters)), ~letters
    cosine = vectors(tf, model.idf) @ model.centroids.T
    best = np.clip(cosine.max(axis=1), 0, 1)
    pred = [model.languages[model.owner[k]] if ok else UNDETERMINED for k, ok in zip(cosine.argmax(axis=1), letters, strict=True)]
    return pred, np.where(letters, best, 0).astype(float), ~letters | (best <= 0) | (best < model.floor[length_class(tf)])


def identify(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """Adds the struct column ``name`` (lang_pred, score, rejected) to doc_id and text of every document.

    Null, empty and letterless texts are ``und`` with score 0 and rejected. A rejected text with letters keeps its nearest
    language. Equal texts get equal predictions; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most clusters x languages rows of DIMS numbers
    schema = T.StructType([*docs.schema.fields, T.StructField(name, SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], ["doc_id", "text"])
            found = [_score(chunk, shared.value) for _, chunk in chunks([view], most=ROWS)]
            pred = pa.StructArray.from_arrays([pa.array([p for f in found for p in f[0]], pa.string()), pa.array(np.concatenate([f[1] for f in found] or [[]]), pa.float64()), pa.array(np.concatenate([f[2] for f in found] or [[]]).astype(bool), pa.bool_())], ["lang_pred", "score", "rejected"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pred], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    out = identify(narrow(docs, "doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")
