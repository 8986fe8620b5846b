"""Licence scans: a trained paragraph classifier, with DataFrame operations only over the data.

A paragraph is a block of lines between blank lines; its words run on over line ends, and comment marks are no words. The model
has a logistic regression for each licence family over the presence of word unigrams and bigrams, with an L1 penalty that leaves
few weights. It is trained on the notices of ``notices.py``, alone, in other text and in pairs, against text that grants nothing.
Weights are whole numbers (SCALE units), so that sums don't depend on order. A temperature and an offset, fitted on notices held out
of training, calibrate the probabilities. The unknown class has the probability that no family is right; where that is above
MOST_UNKNOWN the paragraph is unknown, whatever family scores best. Else the families with MIN_PROBABILITY are predicted. A
prediction counts only if a template of that family (a name, or a piece of a passage) has MIN_TEMPLATE of its bigrams there.

Every paragraph is classified. For most, one look suffices: words() are such that a paragraph without any of them can't reach
MIN_PROBABILITY for a family, whatever else it holds, since the sum of all positive weights that are left stays under the
intercept. The others' n-grams are joined with the weights; only hashes of places travel with them, never text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.frames import narrow
from vocalis.llm.notices import FUNCTION_WORDS, NAMES, OTHER, PASSAGES, SPDX, VERBS

SCALE = 1000
MIN_PROBABILITY, MIN_TEMPLATE = 0.5, 0.6
#: A paragraph is unknown if no family is right with more than this probability: in doubt, none is named.
MOST_UNKNOWN = 0.3
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Between paragraphs: a line end, then a line without letters and digits.
BLANK = r"\n[^a-z0-9\n]*\n"
#: Words in a piece of a passage.
PIECE = 12
UNKNOWN = "unknown"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(text: str) -> set[str]:
    words = tokens(text)
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def telling(gram: str) -> bool:
    """Whether a word or pair has a word that isn't among the commonest of text without a notice."""
    return not set(gram.split(" ")) <= _common()


@cache
def _common() -> set[str]:
    often: dict[str, int] = {}
    for t in OTHER:
        for w in set(tokens(t)):
            often[w] = often.get(w, 0) + 1
    return {w for w, n in often.items() if n >= 5} | set(FUNCTION_WORDS)


def examples() -> list[tuple[set[str], set[str]]]:
    """(n-grams, families): each name after some of VERBS, identifiers, passages and two thirds of long ones; each of those within other text
    and beside a notice of another family; and text without a notice, alone and in pairs."""
    single = []
    for k, family in enumerate(sorted(NAMES)):
        for i, name in enumerate(NAMES[family]):
            single += [(f"{VERBS[(k + i + 3 * j) % len(VERBS)]} {name}", family) for j in range(3)] + [(name, family)]
        single += [(f"SPDX-License-Identifier: {x}", family) for x in SPDX.get(family, ())]
        for p in PASSAGES[family]:
            ws = p.split()
            single += [(" ".join(part), family) for part in ((ws, ws[: 2 * len(ws) // 3], ws[len(ws) // 3 :]) if len(ws) >= 16 else (ws,))]
    bags = [(grams(t), {f}) for t, f in single]
    other = [grams(t) for t in OTHER]
    bags += [(b | other[(7 * i) % len(other)], f) for i, (b, f) in enumerate(bags)]
    n = len(single)
    bags += [(bags[i][0] | bags[(i * 5 + n // 2) % n][0], bags[i][1] | bags[(i * 5 + n // 2) % n][1]) for i in range(0, n, 2)]
    bags += [(o, set()) for o in other] + [(o | other[(i + s) % len(other)], set()) for s in (1, 5, 17) for i, o in enumerate(other)]
    return [*bags, (set(), set())]


@dataclass
class Model:
    families: list[str]
    grams: list[str]  # those with a weight
    weights: list[list[int]]  # by gram, then family
    intercepts: list[int]  # negative
    temperature: float
    held: list[tuple[set[str], set[str]]]  # what calibrated it: n-grams and families


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray, lasso: float = 3e-4, rounds: int = 120, start: np.ndarray | None = None) -> np.ndarray:
    """Accelerated proximal gradient on the mean logistic loss, positives weighted up to a fifth of all; the intercept comes last and isn't penalised."""
    x = np.column_stack((x, np.ones(len(x)))).astype(np.float32)
    share = y.mean(axis=0, keepdims=True).clip(1e-6)
    weight = (np.where(y > 0, np.maximum(1, 0.2 / share), 1) / len(x)).astype(np.float32)
    step = 4 / float(np.linalg.norm(x, 2) ** 2 / len(x) * weight.max() * len(x))
    w = v = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32) if start is None else start
    t = 1.0
    for _ in range(rounds):
        after = v - step * (x.T @ (weight * (_sigmoid(x @ v) - y)))
        after[:-1] = np.sign(after[:-1]) * np.maximum(np.abs(after[:-1]) - step * lasso, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        w, v = after, after + (before - 1) / t * (after - w)
    return w


@cache
def train() -> Model:
    """Deterministic. The rows held out for the calibration are every fifth one; the offset is part of the intercepts."""
    families = sorted(NAMES)
    rows = examples()
    names = sorted(g for g in set().union(*(grams(t) for family in NAMES for t in (*NAMES[family], *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(family, ())), *PASSAGES[family]))) if telling(g))
    at = {g: k for k, g in enumerate(names)}
    x, y = np.zeros((len(rows), len(names)), dtype=np.float32), np.zeros((len(rows), len(families)), dtype=np.float32)
    for k, (bag, own) in enumerate(rows):
        x[k, [at[g] for g in bag if g in at]] = 1
        y[k, [families.index(f) for f in own]] = 1
    held = np.arange(len(rows)) % 5 == 4
    w = _fit(x[~held], y[~held])
    z = x[held] @ w[:-1] + w[-1]
    odds = lambda t, o: _sigmoid((z + o) / t)
    loss = lambda c: -np.log(np.where(y[held] > 0, odds(*c), 1 - odds(*c)).clip(1e-9)).mean()
    temperature, offset = min(((0.1 * k, 0.1 * o) for k in range(1, 31) for o in range(-15, 1)), key=loss)
    whole = np.rint(_fit(x, y, rounds=60, start=w) * SCALE).astype(int)
    whole[-1] += round(offset * SCALE)
    used = np.flatnonzero((whole[:-1] != 0).any(axis=1))
    return Model(families, [names[k] for k in used], whole[used].tolist(), np.minimum(whole[-1], -1).tolist(), temperature, [r for r, h in zip(rows, held, strict=True) if h])


@cache
def words() -> list[str]:
    """Words of which a paragraph holds one if a family's score can reach 0 (MIN_PROBABILITY): rare and telling words first."""
    model = train()
    weights = np.asarray(model.weights)
    parts = [set(g.split(" ")) for g in model.grams]
    other = [grams(t) for t in OTHER]
    often = {w: sum(w in o for o in other) for w in set().union(*parts)}
    found: set[str] = set()
    for f in range(len(model.families)):
        left = {k: int(weights[k, f]) for k in np.flatnonzero(weights[:, f] > 0) if not parts[k] & found}
        while sum(left.values()) >= -model.intercepts[f]:
            total: dict[str, int] = {}
            for k, v in left.items():
                for w in parts[k]:
                    total[w] = total.get(w, 0) + v
            best = max(sorted(total), key=lambda w: total[w] / (1 + 4 * often[w] ** 2) / (1000 if w in _common() or len(w) < 3 and not w.isalpha() or len(w) < 2 else 1))
            found.add(best)
            left = {k: v for k, v in left.items() if best not in parts[k]}
    return sorted(found)


@cache
def templates() -> list[tuple[str, int, str, int]]:
    """(family, number, bigram or the only word, how many that template has). Numbers are unique over all families."""
    out, number = [], 0
    for family in sorted(NAMES):
        texts = [tokens(n) for n in NAMES[family]] + [tokens(f"SPDX-License-Identifier: {x}") for x in SPDX.get(family, ())]
        for p in PASSAGES[family]:
            t = tokens(p)
            texts += [t[i : i + PIECE] for i in range(0, max(1, len(t) - PIECE // 2), PIECE)]
        for t in texts:
            pairs = sorted({f"{a} {b}" for a, b in zip(t, t[1:], strict=False)}) or t
            out += [(family, number, g, len(pairs)) for g in pairs]
            number += 1
    return out


def pattern() -> str:
    """One regular expression for words(), branched by first letter; it also finds those that a dot or hyphen joins to others."""
    by_letter: dict[str, list[str]] = {}
    for w in words():
        by_letter.setdefault(w[0], []).append(w[1:].replace(".", r"\."))
    return "(?:^|[^a-z0-9])(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(by_letter.items())) + ")(?![a-z0-9])"


def _grams(paragraph: Column) -> Column:
    """Words and pairs of neighbours, each once. A word and the next one make a pair; the last word's pair has no second word."""
    found = F.regexp_extract_all(paragraph, F.lit(TOKEN), F.lit(0))
    pairs = F.zip_with(found, F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(found, pairs))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, place, paragraph) of the paragraphs that hold one of words(), in lower case; ``row`` tells rows of one id apart."""
    text = narrow(docs, "doc_id", "text").select("doc_id", F.lower("text").alias("text")).where(F.col("text").rlike(pattern()))
    blocks = text.select("doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split("text", BLANK)).alias("place", "paragraph"))
    return blocks.where(F.col("paragraph").rlike(pattern()))


def _model_table(spark: SparkSession) -> DataFrame:
    """The model's own rows, some thousand: by gram, its weights and the numbers of the templates that have it."""
    model, of = train(), {}
    for _, number, g, _ in templates():
        of.setdefault(g, []).append(number)
    known = dict(zip(model.grams, model.weights, strict=True))
    rows = [(g, known.get(g, [0] * len(model.families)), of.get(g, [])) for g in sorted({*known, *of})]
    return F.broadcast(spark.createDataFrame(rows, "gram string, weights array<bigint>, templates array<int>"))


def classify(docs: DataFrame) -> DataFrame:
    """One row per paragraph that holds one of words(): doc_id, row, place, p_unknown, predicted, confirmed (arrays of families).

    p_unknown is the calibrated probability that no family is right; above MOST_UNKNOWN nothing is predicted. Paragraphs without such
    a word are unknown and have no row.
    """
    model = train()
    names = model.families
    needs = {number: (number, family, int(np.ceil(MIN_TEMPLATE * size - 1e-9))) for family, number, _, size in templates()}
    every = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(f).alias("family"), F.lit(k).alias("need")) for n, f, k in needs.values()])
    spread = paragraphs(docs).select("doc_id", "row", "place", F.explode(_grams(F.col("paragraph"))).alias("gram"))
    scores = [F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(len(names))]
    sums = spread.join(_model_table(docs.sparkSession), "gram").groupBy("doc_id", "row", "place").agg(*scores, F.flatten(F.collect_list("templates")).alias("hits"))
    z = [F.col(f"s{k}") + model.intercepts[k] for k in range(len(names))]
    free = reduce(lambda a, b: a * b, [1 / (1 + F.exp(s / (SCALE * model.temperature))) for s in z])
    free = F.round(free, 6)
    predicted = F.array_compact(F.array(*[F.when((s >= 0) & (free <= MOST_UNKNOWN), F.lit(f)) for s, f in zip(z, names, strict=True)]))
    shown = F.filter(every, lambda t: F.array_contains("predicted", t["family"]) & (F.size(F.filter("hits", lambda h: h == t["number"])) >= t["need"]))
    out = sums.select("doc_id", "row", "place", "hits", free.alias("p_unknown"), predicted.alias("predicted"))
    return out.select("doc_id", "row", "place", "p_unknown", "predicted", F.array_distinct(F.transform(shown, lambda t: t["family"])).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per id: doc_id, n_predicted, licences (confirmed families in order, joined by a comma), n_unconfirmed, p_unknown.

    p_unknown is the least probability of the unknown class among the paragraphs with a prediction, null without one. n_predicted counts the paragraphs with a predicted family, n_unconfirmed those of them without a confirmed one. Null and empty
    texts, and texts without a notice, have no licence and an empty string. Rows of one id are one document: families of all of
    them, and the most paragraphs of one. An empty table gives an empty result.
    """
    by_row = classify(docs).groupBy("doc_id", "row").agg(
        F.count_if(F.size("predicted") > 0).alias("n_predicted"),
        F.flatten(F.collect_set("confirmed")).alias("families"),
        F.count_if((F.size("predicted") > 0) & (F.size("confirmed") == 0)).alias("n_unconfirmed"),
        F.min(F.when(F.size("predicted") > 0, F.col("p_unknown"))).alias("p_unknown"),
    )
    nothing = narrow(docs, "doc_id").select("doc_id", F.lit(0).cast("bigint").alias("n_predicted"), F.array().cast("array<string>").alias("families"), F.lit(0).cast("bigint").alias("n_unconfirmed"), F.lit(None).cast("double").alias("p_unknown"))
    every = by_row.select("doc_id", "n_predicted", "families", "n_unconfirmed", "p_unknown").unionByName(nothing.distinct())
    out = every.groupBy("doc_id").agg(F.max("n_predicted").alias("n_predicted"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("licences"), F.max("n_unconfirmed").alias("n_unconfirmed"), F.round(F.min("p_unknown"), 4).alias("p_unknown"))
    return out.select("doc_id", "n_predicted", "licences", "n_unconfirmed", "p_unknown")


def oracle_sql() -> str:
    """The whole scan in DuckDB's SQL, with the trained weights and the templates as literal rows; it scores every paragraph."""
    model = train()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({quote(g)}, {w}::BIGINT[])" for g, w in zip(model.grams, model.weights, strict=True))
    pairs = ", ".join(f"({quote(f)}, {i}, {quote(g)}, {n})" for f, i, g, n in templates())
    k = range(len(model.families))
    return f"""
WITH w(gram, weights) AS (VALUES {weights}), t(family, number, gram, size) AS (VALUES {pairs}),
d AS (SELECT doc_id, row_number() OVER () AS rn, string_split_regex(lower(text), '\\n[^a-z0-9\\n]*\\n') AS ps FROM documents),
p AS (SELECT doc_id, rn, unnest(ps) AS paragraph, unnest(range(len(ps))) AS place FROM d),
a AS (SELECT doc_id, rn, place, regexp_extract_all(paragraph, '{TOKEN}') AS ws FROM p),
g AS (SELECT DISTINCT doc_id, rn, place, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram FROM a),
s AS (SELECT doc_id, rn, place, {', '.join(f'sum(weights[{i + 1}])::BIGINT + ({model.intercepts[i]}) AS s{i}' for i in k)} FROM g JOIN w USING (gram) GROUP BY doc_id, rn, place),
u AS (SELECT *, round({' * '.join(f'(1 / (1 + exp(s{i} / {SCALE * model.temperature})))' for i in k)}, 6) AS free FROM s),
f AS (SELECT doc_id, rn, place, unnest([{', '.join(quote(f) for f in model.families)}]) AS family, unnest([{', '.join(f's{i}' for i in k)}]) AS score, free FROM u),
h AS (SELECT doc_id, rn, place, family, max(share) AS share FROM (SELECT doc_id, rn, place, family, number, count(*) / size AS share FROM g JOIN t USING (gram) GROUP BY doc_id, rn, place, family, number, size) GROUP BY doc_id, rn, place, family),
c AS (SELECT f.doc_id, f.rn, f.place, f.family, coalesce(h.share, 0) >= {MIN_TEMPLATE} - 1e-9 AS confirmed, free FROM f LEFT JOIN h ON f.rn = h.rn AND f.place = h.place AND f.family = h.family WHERE f.score >= 0 AND free <= {MOST_UNKNOWN}),
q AS (SELECT doc_id, rn, place, bool_or(confirmed) AS confirmed FROM c GROUP BY doc_id, rn, place),
n AS (SELECT doc_id, rn, count(*) AS n_predicted, count(*) FILTER (WHERE NOT confirmed) AS n_unconfirmed FROM q GROUP BY doc_id, rn),
m AS (SELECT doc_id, max(n_predicted) AS n_predicted, max(n_unconfirmed) AS n_unconfirmed FROM n GROUP BY doc_id),
v AS (SELECT doc_id, round(min(free), 4) AS p_unknown FROM c GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT family, ',' ORDER BY family) AS licences FROM c WHERE confirmed GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_predicted, 0)::BIGINT AS n_predicted, coalesce(licences, '') AS licences, coalesce(n_unconfirmed, 0)::BIGINT AS n_unconfirmed, p_unknown
FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN m ON x.doc_id IS NOT DISTINCT FROM m.doc_id LEFT JOIN l ON x.doc_id IS NOT DISTINCT FROM l.doc_id LEFT JOIN v ON x.doc_id IS NOT DISTINCT FROM v.doc_id
"""
