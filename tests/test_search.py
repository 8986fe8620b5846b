"""Text queries and the stored index, against SQLite's own full-text search and against one build of all chunks."""

from __future__ import annotations

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.operators import index, match
from vocalis.plans import registry
from vocalis.sources import files, index_store

WORDS = ["alpha", "beta", "gamma", "delta", "été", "alphabet", "algae", "bet"]
FIELDS = ["title", "body"]


def chunks(seed: int, n: int = 60) -> list[tuple[str, str, str]]:
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    return [(f"c{i:03d}", say(r.randint(0, 3)), say(r.randint(0, 12))) for i in range(n)]


def random_query(r: random.Random, depth: int = 0) -> str:
    word = lambda: r.choice(WORDS)
    kind = r.random()
    if depth > 2 or kind < 0.35:
        return r.choice([word, word, lambda: word()[:2] + "*", lambda: f'"{word()} {word()}"', lambda: f"{word()} + {word()}", lambda: f"^{word()}", lambda: f'"{word()} {word()[:1]}" *'])()
    if kind < 0.5:
        return f"NEAR({word()} {word()}{r.choice(['', ' ' + word(), ''])}{r.choice(['', ', 0', ', 2', ', 5'])})"
    if kind < 0.6:
        return r.choice(["title", "body", "{title body}", "- title", "-{body}"]) + " : " + r.choice([word(), f"({random_query(r, depth + 1)})"])
    a, b = random_query(r, depth + 1), random_query(r, depth + 1)
    if kind < 0.7:
        return f"({a} {r.choice(['AND', 'OR', 'NOT'])} {b})"
    return f"{a} {r.choice(['AND', 'OR', 'NOT', 'AND', 'OR'])} {b}" if kind < 0.9 else f"({a}) AND {b}"


@pytest.fixture(scope="module")
def lite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(chunk_id UNINDEXED, title, body, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", chunks(1))
    return con


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "a")
    return index_store.append(spark, path, spark.createDataFrame(chunks(1), "chunk_id string, title string, body string"), FIELDS, buckets=8)


def test_queries_against_sqlite(spark, lite, store):
    """Three hundred generated queries at once: the same chunks, and for queries without NEAR the same scores."""
    r = random.Random(2)
    texts = [random_query(r) for _ in range(300)]
    got = {}
    for row in store.search(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, query string")).collect():
        got.setdefault(row.query_id, {})[row.chunk_id] = row.score
    bad = {r_.query_id for r_ in match.plans(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, query string")).where("error is not null").collect()}
    compared = 0
    for k, t in enumerate(texts):
        want = dict(lite.execute("SELECT chunk_id, bm25(t) FROM t WHERE t MATCH ?", (t,)).fetchall())
        assert str(k) not in bad, t
        mine = got.get(str(k), {})
        assert set(mine) == set(want), t
        compound = " OR " in t and any(x in t for x in (" AND ", " NOT "))  # a branch that fails may count for SQLite or not
        if not compound and not any(x in t for x in ("NEAR", "^", ":")):  # there SQLite counts hits and rows of a phrase in its own ways
            compared += len(want)
            assert all(abs(mine[c] - round(want[c], 6)) < 2e-6 for c in want), t
    assert compared > 500


@pytest.mark.parametrize("text", ["", "  ", "alpha AND", "OR beta", "(alpha", "alpha)", '"', "alpha ~ beta", "NEAR(alpha beta, x)", "NOT alpha", "NEAR(", '""', "title :"])
def test_what_cannot_be_read(spark, store, text):
    with pytest.raises(match.QueryError):
        match.parse(text)
    assert [r.error is not None for r in match.plans(spark.createDataFrame([("a", text)], "query_id string, query string")).collect()] == [True]


def test_near_groups_by_brute_force():
    r = random.Random(3)
    for _ in range(300):
        parts = [np.array(sorted(r.sample(range(40), r.randint(0, 6))), dtype=np.int64) for _ in range(r.randint(2, 4))]
        lengths, distance = [r.randint(1, 3) for _ in parts], r.randint(0, 8)
        got = match.near_starts(parts, lengths, distance)
        for k, p in enumerate(parts):
            want = [s for s in p if any(m - distance - lengths[k] <= s <= m and all(any(m - distance - n <= x <= m for x in q) for q, n in zip(parts, lengths, strict=True)) for q_ in parts for m in q_)]
            assert got[k].tolist() == want


def _all(store, text="alpha OR be* OR \"gamma delta\""):
    return sorted(map(tuple, store.search(text).collect()))


def test_additions_and_removals_equal_one_build(spark, tmp_path):
    old, new = chunks(5, 80), chunks(6, 80)
    schema = "chunk_id string, title string, body string"
    df = lambda rows: spark.createDataFrame(rows, schema)
    path = str(tmp_path / "many")
    index_store.append(spark, path, df(old[:30]), FIELDS, buckets=4)
    index_store.append(spark, path, df(old[20:60]), FIELDS)
    index_store.append(spark, path, df(new[10:40] + [(None, "alpha", "beta"), ("empty", None, None)]), FIELDS)
    index_store.delete(spark, path, df(old[5:15] + [("unknown", "", "")]).select("chunk_id"))
    four = index_store.append(spark, path, df(new[8:12] + new[8:10]), FIELDS)
    want = {c[0]: c for c in old[:60]} | {c[0]: c for c in new[10:40]} | {"empty": ("empty", None, None)}
    for c in old[5:15]:
        del want[c[0]]
    want |= {c[0]: c for c in new[8:12]}
    once = index_store.append(spark, str(tmp_path / "once"), df(list(want.values())), FIELDS)
    assert four.corpus().first() == once.corpus().first()
    assert _all(four) == _all(once) and len(_all(once)) > 20
    assert len(four.segments) == 5
    small = index_store.compact(spark, path, fan=2)
    assert len(small.segments) < 3 and small.corpus().first() == once.corpus().first() and _all(small) == _all(once)
    assert index_store.vacuum(spark, path) > 0
    later = index_store.delete(spark, path, df(new[8:9]).select("chunk_id"))
    assert later.corpus().first().documents == once.corpus().first().documents - 1
    assert _all(index_store.open_store(spark, path)) == _all(later)


def test_a_merge_of_the_last_segments_keeps_what_they_removed(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "chunk_id string, body string")
    path = str(tmp_path / "tail")
    for k in range(4):
        index_store.append(spark, path, df([(f"c{k}", "alpha"), (f"d{k}", "beta")]), ["body"], buckets=2)
    index_store.compact(spark, path, fan=4)
    for k in range(2):
        index_store.delete(spark, path, df([(f"c{k}", "")]).select("chunk_id"))
    store = index_store.compact(spark, path, fan=2)
    assert [s["level"] for s in store.segments] == [1, 1] or len(store.segments) == 1
    assert {r.chunk_id for r in store.search("alpha").collect()} == {"c2", "c3"}
    assert store.corpus().first().documents == 6


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    store = index_store.append(spark, str(tmp_path / "plan"), spark.createDataFrame(chunks(7, 200), "chunk_id string, title string, body string"), FIELDS, buckets=8)
    read = store.postings(["alpha", "delta"])
    used = {r.f.split("/bucket=")[1].split("/")[0] for r in read.join(store._read("postings", index_store.POSTINGS).select("term", F.input_file_name().alias("f")), "term").select("f").distinct().collect()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("#", " #").replace("bucket #", "bucket") or "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(term" in plan.split("PushedFilters")[1]
    assert len(used) <= 2


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path / "race")
    df = spark.createDataFrame([("a", "alpha")], "chunk_id string, body string")
    store = index_store.append(spark, path, df, ["body"])
    index_store.delete(spark, path, df.select("chunk_id"))
    with pytest.raises(index_store.ConflictError):
        index_store._commit(store, store.segments)
    assert index_store.open_store(spark, path).version == 2
    assert files.create_text(spark, str(tmp_path / "x"), "one") and not files.create_text(spark, str(tmp_path / "x"), "two")
    assert files.read_text(spark, str(tmp_path / "x")) == "one"
    assert [n for n in files.names(spark, str(tmp_path)) if n.startswith("x")] == ["x"]


def test_an_empty_index(spark, tmp_path):
    store = index_store.open_store(spark, str(tmp_path / "none"))
    assert store.search("alpha").count() == 0
    with pytest.raises(ValueError, match="fields"):
        index_store.append(spark, str(tmp_path / "f"), spark.createDataFrame([("a", "x")], "chunk_id string, body string"), ["body"])
        index_store.append(spark, str(tmp_path / "f"), spark.createDataFrame([("a", "x")], "chunk_id string, other string"), ["other"])
    empty = index_store.append(spark, str(tmp_path / "e"), spark.createDataFrame([], "chunk_id string, body string"), ["body"])
    assert empty.search("alpha").count() == 0 and empty.corpus().first().documents == 0


def test_best_chunks_of_each_query(spark):
    found = spark.createDataFrame([("a", "x", -1.0), ("a", "y", -2.0), ("a", "z", -2.0), ("b", "x", -0.5)], "query_id string, chunk_id string, score double")
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in match.best(found, 2).collect()) == [("a", "y", 1), ("a", "z", 2), ("b", "x", 1)]
    with pytest.raises(ValueError, match="k must"):
        match.best(found, 0)


def test_words_are_placed_row_by_row(spark):
    """Against a plain loop: empty rows, equal rows, and more rows than a slice; no shuffle."""
    r = random.Random(5)
    rows = [(f"c{i % 900}", i, [r.choice([*WORDS, "x" * 40, "ÿ"]) for _ in range(r.choice([0, 1, 3, 40]))]) for i in range(1000)]
    df = index.placed(spark.createDataFrame(rows, "chunk_id string, n int, words array<string>").coalesce(1))
    want = sorted((c, n, w, [k for k, x in enumerate(words) if x == w]) for c, n, words in rows for w in set(words))
    assert sorted(tuple(x) for x in df.collect()) == want
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_the_search_reads_the_conversations_once(spark):
    """What the result still reads are the kept chunks and the index, not the table again."""
    df = registry.QUERIES["pipe_search"](spark, "/root/testdata/sf0.001")
    assert df.count() == 10 and not [f for f in df.inputFiles() if "conversations" in f]
