"""Searches given as text over an inverted index, many at a time.

A query is words, "phrases", prefixes (``word*``), ``^first``, ``field : ...``, ``{a b} : ...``, ``- field : ...``, ``NEAR(a b, n)``,
parentheses, and AND, OR, NOT. Words side by side are joined by AND, tightest; then NOT, AND, OR. Each query becomes a few leaves, a
phrase or a group of near phrases each, and a small program over them. Spark joins all leaves' words with the postings at once,
intersects positions, and runs each query's program on the leaves that a chunk matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.operators import index

AND, OR, NOT = -1, -2, -3
NEAR_WORDS = 10
TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([\w]+)|([(){}:,^*+-]))')
LEAF = "leaf int, part int, parts int, place int, places int, term string, prefix boolean, first boolean, distance int, fields array<string>, without array<string>"


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass
class Plan:
    """``program``: leaf numbers and AND, OR, NOT in postfix order; ``words``: a row of LEAF for each word of each phrase."""

    program: list[int] = field(default_factory=list)
    words: list[tuple] = field(default_factory=list)
    leaves: int = 0


def tokens(text: str) -> list[str]:
    """The words of a text as the index has them."""
    plain = text.lower().translate(str.maketrans(index.ACCENTED, index.PLAIN))
    return [t for t in re.split(r"[\W_]+", plain) if t]


def parse(text: str) -> Plan:
    """A blank or malformed query raises QueryError."""
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise QueryError(f"unexpected {text[at:].strip()[:10]!r} in {text!r}")
        found.append(m.group().strip())
        at = m.end()
    if not found:
        raise QueryError("the query is blank")
    plan, i = Plan(), 0
    here = lambda: found[i] if i < len(found) else None

    def take(what: str | None = None) -> str:
        nonlocal i
        if i == len(found) or (what is not None and found[i] != what):
            raise QueryError(f"expected {what or 'more'} at {' '.join(found[i:])[:20]!r} in {text!r}")
        i += 1
        return found[i - 1]

    def chain(word: str, code: int, below) -> bool:
        some = below()
        while here() == word:
            take()
            right = below()
            if some and right:
                plan.program.append(code)
            elif not some and code == NOT and right:
                raise QueryError(f"nothing before NOT in {text!r}")
            some = some or right
        return some

    scope: list[tuple[list[str] | None, list[str] | None]] = [(None, None)]

    def phrase() -> tuple[list[str], bool, bool]:
        first = here() == "^" and bool(take())
        words: list[str] = []
        while True:
            token = take()
            if not (token[0] == '"' or re.match(r"\w", token)):
                raise QueryError(f"unexpected {token!r} in {text!r}")
            words += tokens(token.strip('"').replace('""', '"') if token[0] == '"' else token)
            if here() != "+":
                break
            take()
        prefix = here() == "*" and bool(take())
        return words, prefix, first

    def leaf(phrases: list[tuple[list[str], bool, bool]], distance: int | None) -> bool:
        phrases = [p for p in phrases if p[0]]
        for part, (words, prefix, first) in enumerate(phrases):
            for place, w in enumerate(words):
                plan.words.append((plan.leaves, part, len(phrases), place, len(words), w, prefix and place == len(words) - 1, first, distance, *scope[-1]))
        if phrases:
            plan.program.append(plan.leaves)
            plan.leaves += 1
        return bool(phrases)

    def fields() -> tuple[list[str] | None, list[str] | None] | None:
        """What stands before a colon, if it does."""
        nonlocal i
        start, less = i, here() == "-"
        i += less
        names: list[str] = []
        if here() == "{":
            i += 1
            while here() not in ("}", None):
                names.append(take().strip('"'))
            i += 1
        elif here() is not None and re.match(r'\w|"', here()):
            names = [take().strip('"')]
        if names and here() == ":":
            i += 1
            return (None, names) if less else (names, None)
        i = start
        return None

    def primary() -> bool:
        over = fields()
        if over is not None:
            outer = scope[-1]
            scope.append((over[0] if outer[0] is None else [f for f in outer[0] if over[0] is None or f in over[0]] if over[0] is not None else outer[0], (outer[1] or []) + over[1] if over[1] else outer[1]))
            some = primary()
            scope.pop()
            return some
        if here() == "(":
            take()
            some = either()
            take(")")
            return some
        if here() == "NEAR" and i + 1 < len(found) and found[i + 1] == "(":
            take()
            take()
            phrases = []
            while here() not in (")", ",", None):
                phrases.append(phrase())
            distance = NEAR_WORDS
            if here() == ",":
                take()
                number = take()
                if not number.isdigit():
                    raise QueryError(f"{number!r} is no number of words in {text!r}")
                distance = int(number)
            take(")")
            return leaf(phrases, distance)
        if here() in ("AND", "OR", "NOT", None):
            raise QueryError(f"unexpected {here() or 'end'} in {text!r}")
        return leaf([phrase()], None)

    def side_by_side() -> bool:
        some = primary()
        while here() not in (None, ")", "AND", "OR", "NOT"):
            right = primary()
            if some and right:
                plan.program.append(AND)
            some = some or right
        return some

    def without() -> bool:
        return chain("NOT", NOT, side_by_side)

    def both() -> bool:
        return chain("AND", AND, without)

    def either() -> bool:
        return chain("OR", OR, both)

    some = either()
    if i < len(found):
        raise QueryError(f"unexpected {found[i]!r} in {text!r}")
    if not some:
        raise QueryError(f"no words in {text!r}")
    return plan


def plans(queries: DataFrame) -> DataFrame:
    """From (query_id, query): (query_id, program, words, error); a query that can't be read has its error and nothing else."""
    schema = f"query_id string, program array<int>, words array<struct<{', '.join(c.replace(' ', ':', 1) for c in LEAF.split(', '))}>>, error string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LEAF.split(", ")]
        for b in batches:
            out = []
            for q, text in zip(b["query_id"], b["query"], strict=True):
                try:
                    p = parse(text or "")
                    out.append((q, p.program, [dict(zip(names, w, strict=True)) for w in p.words], None))
                except QueryError as e:
                    out.append((q, None, None, str(e)))
            yield pd.DataFrame(out, columns=["query_id", "program", "words", "error"])

    return queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("query").cast("string").alias("query")).mapInPandas(work, schema)


def near_starts(parts: list[np.ndarray], lengths: list[int], distance: int) -> list[np.ndarray]:
    """Of each phrase's starts, those in a group: one of every phrase, none ending more than ``distance`` words before the last starts."""
    kept = [np.zeros(len(p), dtype=bool) for p in parts]
    for last in parts:
        spans = [(np.searchsorted(p, last - distance - n), np.searchsorted(p, last, side="right")) for p, n in zip(parts, lengths, strict=True)]
        ok = np.all([a < b for a, b in spans], axis=0) if len(last) else np.zeros(0, dtype=bool)
        for k, (a, b) in enumerate(spans):
            edge = np.zeros(len(parts[k]) + 1, dtype=np.int64)
            np.add.at(edge, a[ok], 1)
            np.add.at(edge, b[ok], -1)
            kept[k] |= np.cumsum(edge)[:-1] > 0
    return [p[k] for p, k in zip(parts, kept, strict=True)]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def near_counts(parts: pd.Series, distance: pd.Series) -> pd.Series:
    """Hits of each phrase of a near group, or none if there is no group. ``parts``: structs of part, places and starts."""
    out = []
    for own, d in zip(parts, distance, strict=True):
        own = sorted(own, key=lambda p: p["part"])
        kept = near_starts([np.sort(np.asarray(p["starts"], dtype=np.int64)) for p in own], [p["places"] for p in own], int(d))
        out.append([len(k) for k in kept] if all(len(k) for k in kept) else [])
    return pd.Series(out)


def leaf_hits(postings: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, leaf, part, chunk_id, tf, n): the phrases of the leaves that a chunk matches.

    ``postings``: (term, chunk_id, field, positions, n); ``words``: query_id and LEAF.
    """
    exact = words.where(~F.col("prefix")).select("*", F.col("term").alias("at"))
    lengths = [r.k for r in words.where("prefix").select(F.length("term").alias("k")).distinct().collect()]  # the lengths of prefixes: a handful
    known = postings.select("term").distinct().withColumnRenamed("term", "at") if lengths else None
    for k in sorted(lengths):
        some = words.where(F.col("prefix") & (F.length("term") == k))
        exact = exact.unionByName(some.join(known.withColumn("start", F.substring("at", 1, k)), F.col("start") == F.col("term")).drop("start"))
    hits = exact.join(postings.withColumnRenamed("term", "at"), "at")
    allowed = F.coalesce(F.array_contains("fields", F.col("field")), F.lit(True)) & ~F.coalesce(F.array_contains("without", F.col("field")), F.lit(False))
    by = ["query_id", "leaf", "part", "chunk_id", "field"]
    moved = F.transform("positions", lambda p: p - F.col("place"))
    places = hits.where(allowed).groupBy(*by, "place", "places", "parts", "first", "distance").agg(F.flatten(F.collect_list(moved)).alias("starts"), F.first("n").alias("n"))
    phrases = places.groupBy(*by, "places", "parts", "first", "distance").agg(F.collect_list("starts").alias("each"), F.first("n").alias("n")).where(F.size("each") == F.col("places"))
    starts = F.aggregate(F.slice("each", 2, F.col("places")), F.col("each")[0], F.array_intersect)
    phrases = phrases.withColumn("starts", F.when(F.col("first"), F.filter(starts, lambda p: p == 0)).otherwise(starts)).where(F.size("starts") > 0)
    alone = phrases.where("parts = 1").select(*by, F.size("starts").alias("tf"), "n")
    group = phrases.where("parts > 1").groupBy("query_id", "leaf", "chunk_id", "field", "parts", "distance").agg(F.collect_list(F.struct("part", "places", "starts")).alias("own"), F.first("n").alias("n"))
    near = group.where(F.size("own") == F.col("parts")).withColumn("counts", near_counts("own", "distance"))
    near = near.select("query_id", "leaf", "chunk_id", "field", "n", F.posexplode("counts").alias("part", "tf"))
    return alone.unionByName(near).groupBy("query_id", "leaf", "part", "chunk_id").agg(F.sum("tf").alias("tf"), F.first("n").alias("n"))


def _holds(program, leaves):
    """A postfix program over the leaves that a chunk matches, as a column."""

    def step(stack, op):
        a, b = F.element_at(stack, -2), F.element_at(stack, -1)
        both = F.when(op == AND, a & b).when(op == OR, a | b).otherwise(a & ~b)
        return F.when(op >= 0, F.concat(stack, F.array(F.array_contains(leaves, op)))).otherwise(F.concat(F.slice(stack, 1, F.size(stack) - 2), F.array(both)))

    return F.aggregate(program, F.array().cast("array<boolean>"), step)[0]


def search(postings: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that a query matches; more negative scores are better.

    ``postings``: (term, chunk_id, field, positions, n); ``corpus``: one row (documents, total); ``queries``: (query_id, query). The
    score is BM25 with each phrase of the query as a term. A query that can't be read matches nothing: plans() names its error.
    """
    parsed = plans(queries).where("error is null")
    words = parsed.select("query_id", F.inline("words"))
    hits = leaf_hits(postings, words)
    spread = hits.groupBy("query_id", "leaf", "part").agg(F.count("*").alias("df"))
    scored = hits.join(spread, ["query_id", "leaf", "part"]).crossJoin(F.broadcast(corpus))  # a single row
    idf = F.greatest(F.lit(index.LEAST_IDF), F.log((F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = index.K1 * (1 - index.B + index.B * F.col("n") / (F.col("total") / F.col("documents")))
    each = scored.withColumn("s", -idf * F.col("tf") * (index.K1 + 1) / (F.col("tf") + norm))
    # summed in the order of the phrases, so that a score doesn't depend on how rows meet
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("leaf", "part", "s"))), F.lit(0.0), lambda a, x: a + x["s"])
    found = each.groupBy("query_id", "chunk_id").agg(F.collect_set("leaf").alias("leaves"), total.alias("score"))
    found = found.join(parsed.select("query_id", "program"), "query_id").where(_holds(F.col("program"), F.col("leaves")))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each query; equal scores in the order of ids."""
    from pyspark.sql.window import Window as W

    if k < 1:
        raise ValueError("k must be at least 1")
    order = W.partitionBy("query_id").orderBy("score", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
