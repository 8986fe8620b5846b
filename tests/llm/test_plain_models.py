"""The language and toxicity queries against straight versions, one document at a time, with the same trained numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from vocalis.llm import language, toxicity
from vocalis.llm.kernels import Chunk, word_hashes

TEXTS = ["The cat sat on the mat", "Le chat est là, ÉTÉ comme hiver", "der Hund läuft über die Straße", "el perro no está aquí", "x", "", "  \n ", "1234 5678", "ÀÉÎ", "日本語のテキスト", "a\nb\tc", "The cat sat on the mat", "END"]


def plain_grams(text: str) -> dict[int, int]:
    """N-gram counts of one text, by the same slots."""
    out = []
    raw = text.encode()
    for i, c in enumerate(raw):
        if i and raw[i - 1] == 0xC3 and 0x80 <= c < 0x9F:
            c += 0x20
        out.append(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalpha() else c)
    out = [32, *out, 32]
    slots: dict[int, int] = {}
    for i in range(len(out) - 1):
        if out[i : i + 2] != [32, 32]:
            slot = (((out[i] << 8 | out[i + 1]) * 2654435761) % 2**32) >> 20
            slots[slot] = slots.get(slot, 0) + 1
        if i + 2 < len(out) and out[i + 1] != 32:
            slot = (((out[i] << 16 | out[i + 1] << 8 | out[i + 2]) * 2654435761) % 2**32) >> 20
            slots[slot] = slots.get(slot, 0) + 1
    return slots


def test_counts_are_those_of_each_text_alone():
    found = language.counts(Chunk(np.arange(len(TEXTS)), [t.encode() for t in TEXTS]))
    for k, t in enumerate(TEXTS):
        want = plain_grams(t)
        assert {i: int(found[k][i]) for i in np.flatnonzero(found[k])} == want


def test_equal_texts_get_equal_rows_beside_any_neighbour(spark):
    r = random.Random(3)
    texts = [(k, r.choice(TEXTS[:4]) + " " + r.choice(["", "ja", "oui"])) for k in range(200)]
    docs = spark.createDataFrame([(k, t, "en" if t.startswith("The") else "xx") for k, t in texts], "doc_id bigint, text string, lang string").repartition(7)
    rows = {}
    text = dict(texts)
    for x in language.predict(docs, language.fit(docs)).collect():
        rows.setdefault(text[x.doc_id], set()).add((x.lang_pred, x.score, x.rejected))
    assert all(len(v) == 1 for v in rows.values())


def test_languages_by_plain_cosines(spark):
    """Every document of the small tables: the nearest centroid by cosine, computed from dictionaries of counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    centroids = model.centroids.astype(float)
    for d in docs.select("doc_id", "text").collect():
        text = d.text or ""
        weights = {i: n * float(model.idf[i]) for i, n in plain_grams(text).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * c[i] for i, w in weights.items()) / norm if norm else 0.0 for c in centroids]
        letters = any(c.isalpha() for c in text)
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert got[d.doc_id].lang_pred == (model.languages[model.owner[best]] if letters else "und")
        assert got[d.doc_id].score == pytest.approx(min(1.0, max(0.0, cosines[best])) if letters else 0.0, abs=1e-4)


def words_of(text: str) -> set[int]:
    """Hashes of a text's distinct letter runs."""
    runs, run = [], []
    for c in text.encode() + b" ":
        c = c + 32 if 65 <= c <= 90 else c
        if 97 <= c <= 122 or c >= 128:
            run.append(c)
        elif run:
            runs.append(bytes(run))
            run = []
    out = set()
    for w in runs:
        buf = np.frombuffer(w + b" ", dtype=np.uint8)
        out.add(int(word_hashes(buf, np.zeros(1, dtype=np.int64), np.full(1, len(w)))[0]))
    return out


def test_toxicity_by_a_plain_chain(spark):
    """Every document of the small tables: each category's probability from its words and the log odds of the categories before."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    links = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.score(docs, links).collect()}
    names = [name for name, _ in toxicity.CATEGORIES]
    for d in docs.select("doc_id", "text").collect():
        words = words_of(d.text or "")
        p: list[float] = []
        for link in links:
            z = link.intercept + sum(w for h, w in zip(link.words.tolist(), link.weights.tolist(), strict=True) if h in words)
            z += sum(w * math.log(min(max(q, 1e-4), 1 - 1e-4) / (1 - min(max(q, 1e-4), 1 - 1e-4))) for q, w in zip(p, link.earlier.tolist(), strict=True))
            p.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        p = p if words else [0.0] * len(p)
        row = got[d.doc_id]
        assert [row[f"p_{n}"] for n in names] == pytest.approx(p, abs=1e-9)
        assert row.toxic == (p[0] >= links[0].threshold and p[0] > 0)
        assert row.categories == ",".join(n for n, q, link in zip(names, p, links, strict=True) if q >= link.threshold and q > 0)


def test_a_chain_fitted_step_by_step():
    """train() against a loop that fits each fold and category in turn, by gradient descent to the same optimum."""
    r = np.random.default_rng(4)
    n, vocab = 240, 30
    x = (r.random((n, vocab)) < 0.3).astype(float)
    first = (x[:, 0] + x[:, 1] > 0).astype(int)
    labels = np.column_stack((first, first * (x[:, 2] > 0)))
    doc, col = np.nonzero(x)
    word = (col + 1).astype(np.uint64) * np.uint64(1 << 40)
    fold = np.arange(n) % toxicity.FOLDS
    links = toxicity.train(doc, word, labels, fold)
    out = np.zeros(labels.shape)

    def plain(rows, y, k):
        words = toxicity.select(np.searchsorted(np.flatnonzero(rows), doc[rows[doc]]), word[rows[doc]], y[rows])
        cols = (words // np.uint64(1 << 40)).astype(int) - 1
        z = np.column_stack((x[:, cols], toxicity.log_odds(out[:, :k]), np.ones(n)))
        w = np.zeros(z.shape[1])
        penalty = np.r_[np.full(len(w) - 1, 0.1), 1e-6]
        rate = 1 / (0.25 * np.linalg.norm(z[rows], 2) ** 2 + 0.1)
        for _ in range(60_000):
            step = z[rows].T @ (1 / (1 + np.exp(-z[rows] @ w)) - y[rows]) + penalty * w
            w -= rate * step
            if np.abs(step).max() < 1e-8:
                break
        return w, z

    for k in range(2):
        y = labels[:, k].astype(float)
        for f in range(toxicity.FOLDS):
            w, z = plain(fold != f, y, k)
            out[fold == f, k] = 1 / (1 + np.exp(-z[fold == f] @ w))
        w, _ = plain(np.ones(n, dtype=bool), y, k)
        got = np.r_[links[k].weights, links[k].earlier, links[k].intercept]
        assert got == pytest.approx(w, abs=0.02)
    assert len(links[1].earlier) == 1
