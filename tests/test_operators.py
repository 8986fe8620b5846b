"""Small frames with results known by hand, and properties."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vocalis.functions import text_udf
from vocalis.operators import folds, fuzzy, index, intervals, quality, rules, sequences
from vocalis.sources import readers, sinks
from vocalis.streaming import tail


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def words(spark, sizes):
    return spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "doc_id bigint, idx bigint, words bigint")


@pytest.mark.parametrize(("sizes", "overlap", "want"), [([50, 10, 5], 0, [(0, 1, 1), (1, 2, 3)]), ([20, 30, 10], 10, [(0, 1, 2), (1, 2, 3), (2, 3, 3)]), ([45], 5, [(0, 1, 1), (1, 1, 1)]), ([5], 5, [(0, 1, 1)])])
def test_budget_chunks(spark, sizes, overlap, want):
    got = folds.budget_chunks(words(spark, sizes), 40, overlap)
    assert [r[1:] for r in rows(got, "chunk")] == want


def test_budget_chunks_dont_depend_on_partitions(spark):
    df = spark.range(200).selectExpr("id % 5 AS doc_id", "id AS idx", "id % 23 AS words")
    a = rows(folds.budget_chunks(df.repartition(1), 60, 20), "doc_id", "chunk")
    assert a == rows(folds.budget_chunks(df.repartition(7), 60, 20), "doc_id", "chunk")


def test_turns(spark):
    df = spark.createDataFrame([(1, 0, "A", 0, 2000), (1, 1, "B", 2000, 2400), (1, 2, "A", 2400, 4000)], "doc_id bigint, idx bigint, speaker string, t0 bigint, t1 bigint")
    assert {r.turn for r in folds.stable_turns(df).collect()} == {1}


def test_overlap_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 300_000)], "doc_id bigint, a0 bigint, a1 bigint")
    b = spark.createDataFrame([(1, 10, 200_000), (1, 300_000, 310_000)], "doc_id bigint, b0 bigint, b1 bigint")
    assert rows(intervals.overlap(a, b, ("a0", "a1"), ("b0", "b1")), "b0") == [(1, 0, 300_000, 10, 200_000)]


def test_long_spans_and_many_rows_join_by_buckets(spark):
    far = 10**12
    a = spark.createDataFrame([(1, 0, far), (1, far, far + 1), (1, 5, 5)], "doc_id bigint, a0 bigint, a1 bigint")
    b = spark.createDataFrame([(1, far - 1, far + 5), (1, 3, 9), (2, 0, far)], "doc_id bigint, b0 bigint, b1 bigint")
    assert rows(intervals.overlap(a, b, ("a0", "a1"), ("b0", "b1")).select("a0", "b0"), "a0", "b0") == [(0, 3), (0, far - 1), (5, 3), (far, far - 1)]
    points = spark.range(0, 20_000).selectExpr("1 AS doc_id", "id AS idx", "id * 400 AS t")
    spans = spark.range(0, 200).selectExpr("1 AS doc_id", "id AS turn", "id * 40000 AS s0", "id * 40000 + 39999 AS s1", "concat('s', id) AS speaker")
    got = intervals.at_point(points, spans, points.t, ("s0", "s1"), "turn", "speaker", ("doc_id", "idx"))
    assert got.where("speaker <> concat('s', idx div 100)").count() == 0
    holes = intervals.at_point(points.where("idx < 300"), spans.where("turn <> 1"), points.t, ("s0", "s1"), "turn", "speaker", ("doc_id", "idx"))
    assert {r.speaker for r in holes.where("idx >= 100 and idx < 200").collect()} == {"s199"}


def test_folds_of_a_long_document(spark):
    df = spark.range(0, 20_000).selectExpr("1 AS doc_id", "id AS idx", "concat('s', (id div 3) % 2) AS speaker", "10 AS chars")
    got = folds.paragraphs(df.selectExpr("doc_id", "idx", "speaker", "cast(chars AS bigint) AS chars"))
    assert got.where("paragraph <> idx div 3").count() == 0
    assert got.count() == 20_000


def test_chunk_names_dont_collide(spark):
    from vocalis.sources.adapters import row_id

    ids = spark.range(0, 5_000).selectExpr("1 AS d", "id AS k").unionByName(spark.range(0, 5_000).selectExpr("6 AS d", "id AS k"))
    assert ids.select(row_id(ids.d, ids.k).alias("name")).distinct().count() == 10_000


def test_redundancy_by_a_plain_fold(spark):
    """Whole documents folded in one go, against islands of which only those with a likely repeat are folded."""
    import random

    r = random.Random(8)
    say = lambda: " ".join("".join(r.choices("aeioulmnrst", k=r.randint(2, 7))) for _ in range(r.randint(1, 8)))
    out, want = [], []
    for d in range(12):
        t, said, kept = 0, [say() for _ in range(6)], []
        for i in range(40):
            text_ = r.choice(said) if d % 3 and r.random() < 0.4 else say()
            if r.random() < 0.3:
                text_ = text_.upper() + " x"[: r.randint(0, 2)]
            end = t + r.randint(300, 3000)
            out.append((d, i, text_, t, end))
            key = " ".join(text_.lower().split())
            if not (len(key) >= 8 and sequences.redundant(key, t, kept, 0.9, 3, 5_000)):
                kept.append((key, end))
                want.append((d, i))
            t = end + r.choice([0, 200, 4_000, 5_001, 9_000])
    df = spark.createDataFrame(out, "doc_id bigint, idx bigint, text string, t0 bigint, t1 bigint")
    assert rows(sequences.drop_redundant(df), "doc_id", "idx") == want
    assert len(want) < len(out)


def test_cleaning_by_islands(spark):
    pause = [(1, k, "S", f"bonjour numéro {k % 2} pour tout le monde", 10_000 * (k // 2) + 1_000 * (k % 2), 10_000 * (k // 2) + 1_000 * (k % 2) + 900) for k in range(8)]
    got = sequences.clean(spark.createDataFrame(pause, "doc_id bigint, idx bigint, speaker string, text string, t0 bigint, t1 bigint"))
    assert rows(got.select("idx", "merged"), "idx") == [(0, 0), (2, 0), (4, 0), (6, 0)]  # the second of each pair repeats the first, the next pair is too late for that


def test_redundancy_respects_time(spark):
    near = [(1, 0, "bonjour tout le monde", 0, 1000), (1, 1, "bonjour tout le monde.", 1200, 2000), (1, 2, "bonjour tout le monde", 90_000, 91_000)]
    df = spark.createDataFrame(near, "doc_id bigint, idx bigint, text string, t0 bigint, t1 bigint")
    assert [r[1] for r in rows(sequences.drop_redundant(df), "idx")] == [0, 2]


def test_confidence_summary(spark):
    df = spark.createDataFrame([(1, c) for c in (90, 10, 50)] + [(1, None)], "doc_id bigint, conf bigint")
    assert rows(quality.confidence_summary(df), "doc_id") == [(1, 3, 0.5, 0.1, 0.9, 0.1, 0.5)]


def test_search(spark):
    built = index.build(spark.createDataFrame([(1, "l'installation du serveur"), (2, "le serveur est prêt"), (3, "rien")], "chunk_id bigint, text string"))
    assert rows(index.match_phrase(built, ["serveur", "est"]), "chunk_id") == [(2,)]
    assert [r[0] for r in rows(index.bm25(built, ["pret"], 5), "score")] == [2]
    assert rows(index.match_not(built, "serveur", "installation"), "chunk_id") == [(2,)]


def test_rules():
    assert rules.validate([("a", "x"), (" ", "y"), ("[", "z"), ("a", "w")]) == [("a", "w")]
    assert rules.java_replacement(r"\g<name> \1 $") == r"${name} $1 \$"
    with pytest.raises(ValueError):
        rules.validate([("a", "b")] * 501)


def test_marks_and_repeats():
    words = [{"word": "Bonjour", "probability": 0.9}, {"word": "monde", "probability": 0.1}]
    assert text_udf.mark_text("Bonjour monde.", words) == "Bonjour **[monde.?]**"
    assert text_udf.mark_text("a b a", [{"word": "a", "probability": 0.1}, {"word": "x", "probability": 0.1}, {"word": "a", "probability": 0.9}]) == "**[a?]** b a"
    assert text_udf.local_repeats("il est Il est il est parti. oui oui je viens") == "il est parti.oui oui je viens"
    assert text_udf.local_repeats("a, b a b") == "a, b a b"
    assert text_udf.local_repeats("A. B\n\nC d.") == "A.B C d."
    assert text_udf.local_repeats("a b c a b c a b d") == "a b c a b d"
    assert text_udf.local_repeats("x " * 5000) == " ".join(["x"] * 2) or len(text_udf.local_repeats("x " * 5000).split()) < 4
    assert text_udf.human_text("Il vient. , puis il part,") == "Il vient.puis il part"
    assert text_udf.human_text(" LIA dit bonjour  à tous , enfin ", glossary={"bonjour": "Salut"}) == "l’IA dit Salut à tous , enfin"
    assert text_udf.repair("dÃ©jÃ  vu") != "dÃ©jÃ  vu"


@given(st.text())
def test_machine_form_is_idempotent(s):
    once = text_udf.machine_form(s)
    assert text_udf.machine_form(once) == once


def test_readers_and_sinks(spark, tmp_path):
    doc = {"segments": [{"start": 0.0, "end": 1.5, "text": "a b", "words": [{"word": "a", "score": 0.5}, {"word": "b", "probability": 1.0}]}, {"start": 1.5, "end": 2.0, "text": "x", "text_human": "y z w", "confidence": 0.25}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    got = readers.segment_documents(spark, str(tmp_path / "d.json")).select("idx", "start_ms", "end_ms", "text", "confidence", "n_words")
    assert rows(got, "idx") == [(0, 0, 1500, "a b", 0.75, 2), (1, 1500, 2000, "y z w", 0.25, 3)]
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n{bad\n')
    assert [r[0] for r in rows(readers.json_lines(spark, str(tmp_path / "l.jsonl"), "k bigint"), "k")] == [None, 1]
    out = str(tmp_path / "out")
    sinks.write_json_lines(spark.createDataFrame([(2, "b"), (1, "a")], "z bigint, a string"), out, ["z"])
    assert spark.read.json(out).columns == ["a", "z"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_json_lines(spark.range(1).toDF("z"), out, ["z"])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("one\ntwo\n")
    q = tail.tail(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.line for r in spark.table("lines").collect()} == {"one", "two"}


def test_queries_dont_need_the_llm_folders():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "vocalis"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "vocalis.llm" not in f.read_text()
