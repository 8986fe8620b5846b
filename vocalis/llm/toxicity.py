"""Toxicity by a classifier chain.

The categories are predicted one after another by logistic regressions over word presence; each later model also sees the
probabilities of the earlier categories. In training those are out-of-fold predictions, so that a later model meets earlier
probabilities as good as they will be on new text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.frames import narrow
from vocalis.llm.kernels import LOWER, NULL_ID, U64, Chunk, chunks, word_hashes

#: In chain order, from the columns of the label table: toxic at all, toxic in good prose, toxic in poor text.
CATEGORIES: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("toxic", lambda: F.col("toxic") == 1),
    ("toxic_prose", lambda: (F.col("toxic") == 1) & (F.col("quality") == 1)),
    ("toxic_junk", lambda: (F.col("toxic") == 1) & (F.col("quality") == 0)),
)
FOLDS, FEATURES, MIN_DOCUMENTS, MIN_EVIDENCE = 4, 200, 4, 20.0


@dataclass
class Link:
    """One model of the chain: word hashes (sorted) with weights, weights of the earlier categories' log odds, intercept, threshold."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float
    threshold: float = 0.5


def presence(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, word hash) of the letter runs of each whole text, A-Z in lower case."""
    buf = LOWER[chunk.buf]
    letter = (buf >= 97) & (buf <= 122) | (buf >= 128)
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    h = word_hashes(buf, starts, ends)
    doc = np.searchsorted(chunk.ends, starts, side="right")
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    lead = np.ones(len(h), dtype=bool)
    lead[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[lead], h[lead]


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def select(doc: np.ndarray, word: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The words of most evidence for or against, by the likelihood ratio of their documents' share of positives against all documents' share."""
    found, index = np.unique(word, return_inverse=True)
    n = np.bincount(index, minlength=len(found)).astype(float)
    one = np.bincount(index, weights=y[doc], minlength=len(found))
    base = y.mean()
    term = lambda k, share: k * np.log(np.maximum(k, 1e-12) / np.maximum(n * share, 1e-12))
    evidence = 2 * (term(one, base) + term(n - one, 1 - base))
    good = np.flatnonzero((n >= MIN_DOCUMENTS) & (evidence >= MIN_EVIDENCE))
    return np.sort(found[good[np.argsort(-evidence[good], kind="stable")[:FEATURES]]])


def distinct(doc: np.ndarray, word: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of documents with the same words and the same labels, the first: copies would count as evidence more than once."""
    first = np.searchsorted(doc, np.arange(len(labels) + 1))
    seen: set[tuple] = set()
    keep = np.zeros(len(labels), dtype=bool)
    for k in range(len(labels)):
        whole = (word[first[k] : first[k + 1]].tobytes(), tuple(labels[k].tolist()))
        keep[k] = whole not in seen
        seen.add(whole)
    return keep


def matrix(doc: np.ndarray, word: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
    x = np.zeros((n, len(words)))
    if len(words):
        at = np.minimum(np.searchsorted(words, word), len(words) - 1)
        hit = words[at] == word
        x[doc[hit], at[hit]] = 1
    return x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept comes last and isn't penalised."""
    x = np.column_stack((x, np.ones(len(x))))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply(links: list[Link], doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """The probability of each category for each document."""
    out = np.zeros((n, len(links)))
    for k, link in enumerate(links):
        score = matrix(doc, word, n, link.words) @ link.weights + log_odds(out[:, :k]) @ link.earlier + link.intercept
        out[:, k] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return out


def train(doc: np.ndarray, word: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Link]:
    """labels: a column for each category. The thresholds maximise F1 of the out-of-fold probabilities."""
    n, links, out_of_fold = len(labels), [], np.zeros(labels.shape)
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)

        def fit(rows: np.ndarray, y=y, k=k) -> Link:
            use = rows[doc]
            place = np.cumsum(rows) - 1
            words = select(place[doc[use]], word[use], y[rows]) if 0 < y[rows].sum() < rows.sum() else np.zeros(0, dtype=U64)
            w = logistic(np.column_stack((matrix(doc, word, n, words)[rows], log_odds(out_of_fold[rows, :k]))), y[rows])
            return Link(words, w[: len(words)], w[len(words) : -1], float(w[-1]))

        for f in range(FOLDS):
            link = fit(fold != f)
            held = fold == f
            score = matrix(doc, word, n, link.words)[held] @ link.weights + log_odds(out_of_fold[held, :k]) @ link.earlier + link.intercept
            out_of_fold[held, k] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        link = fit(np.ones(n, dtype=bool))
        order = np.argsort(-out_of_fold[:, k], kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, n + 1) + max(1, y.sum()))
        last = int(f1.argmax())
        low = out_of_fold[order[min(last + 1, n - 1)], k]
        link.threshold = float(np.clip((out_of_fold[order[last], k] + low) / 2, 0.05, 0.95)) if y.sum() else 1.0
        links.append(link)
    return links


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> list[Link]:
    """Trains on about ``rows`` labelled documents (whole texts), those of least id hash.

    Null labels count as 0; unlabelled and null texts are not used. The sampled ids are broadcast (about ``rows`` of them), so the
    texts are read in the scan and only word hashes of the sample leave it.
    """
    known = narrow(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull())
    flags = known.groupBy("doc_id").agg(*[F.max(F.coalesce(rule(), F.lit(False)).cast("int")).alias(name) for name, rule in CATEGORIES])
    n = max(1, flags.count())
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    names = [name for name, _ in CATEGORIES]
    drawn = flags.where(draw < int((1 << 30) * min(1.0, rows / n))).collect()
    nothing = [Link(np.zeros(0, dtype=U64), np.zeros(0), np.zeros(k), -30.0, 1.0) for k in range(len(CATEGORIES))]
    if not drawn:
        return nothing
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(r.doc_id,) for r in drawn], "__drawn bigint"))
    sample = narrow(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(ids, F.col("doc_id") == F.col("__drawn"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in chunks(batches):
            doc, word = presence(chunk)
            first = np.searchsorted(doc, np.arange(len(chunk.ids) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([word[a:b].tobytes() for a, b in pairwise(first.tolist())], pa.binary())], ["doc_id", "words"])

    found = sorted(sample.mapInArrow(run, "doc_id bigint, words binary").collect(), key=lambda r: (r.doc_id, bytes(r.words)))
    if not found:
        return nothing
    flag = {r.doc_id: [r[name] for name in names] for r in drawn}
    y = np.asarray([flag[r.doc_id] for r in found])
    bags = [np.frombuffer(r.words, dtype=U64) for r in found]
    doc, word = np.repeat(np.arange(len(bags)), [len(w) for w in bags]), np.concatenate(bags)
    keep = distinct(doc, word, y)
    use = keep[doc]
    place = np.cumsum(keep) - 1
    return train(place[doc[use]], word[use], y[keep], np.arange(int(keep.sum())) % FOLDS)


SCHEMA = "doc_id bigint, toxic boolean, " + ", ".join(f"p_{name} double" for name, _ in CATEGORIES) + ", categories string"


def score(docs: DataFrame, links: list[Link]) -> DataFrame:
    """One row per document: doc_id, toxic, a probability for each category, and the names of those over their threshold.

    Null, empty and letterless texts are not toxic, with probability 0. Equal texts get equal rows; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(links)  # at most FEATURES words a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in CATEGORIES]
        limit = np.asarray([link.threshold for link in shared.value])
        for _, chunk in chunks(batches):
            doc, word = presence(chunk)
            p = apply(shared.value, doc, word, len(chunk.ids))
            p[np.bincount(doc, minlength=len(chunk.ids)) == 0] = 0
            over = (p >= limit) & (p > 0)
            ids = pa.array(chunk.ids, mask=chunk.ids == NULL_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(over[:, 0]), *(pa.array(p[:, k]) for k in range(len(names))), pa.array([",".join(n for n, o in zip(names, row, strict=True) if o) for row in over], pa.string())], ["doc_id", "toxic", *(f"p_{n}" for n in names), "categories"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
