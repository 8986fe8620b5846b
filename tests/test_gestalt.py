"""The gestalt ratio against the standard library, the bounds before it, and text functions in slices of a batch."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vocalis.functions import text_udf
from vocalis.operators import sequences

TEXTS = st.text(alphabet="abcé ", max_size=30)


@given(TEXTS, TEXTS)
def test_the_ratio_is_the_standard_librarys(a, b):
    assert text_udf.gestalt_ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_common_letters_of_long_texts_begin_no_block():
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    weights = [r.randint(1, 40) if k < 26 else 1 for k in range(52)]
    for _ in range(300):
        a = r.choices(letters, weights, k=r.randint(150, 400))
        b = list(a) if r.random() < 0.7 else r.choices(letters, weights, k=r.randint(150, 400))
        for _ in range(r.randint(0, 30)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 5)] = r.choices(letters, k=r.randint(0, 5))
        a, b = "".join(a), "".join(b)
        want = SequenceMatcher(None, a, b).ratio()
        assert text_udf.gestalt_ratio(a, b) == want
        assert all(text_udf.reaches(a, b, t) == (want >= t) for t in (0.55, 0.9))


def test_unlike_lines_cost_little():
    """F2, F8: a thousand pairs of lines of one vocabulary; the ratio itself takes more than a millisecond for each."""
    r = random.Random(2)
    say = lambda: " ".join("".join(r.choices(["th", "an", "er", "ing", "tion", "re"], k=3)) for _ in range(50))
    pairs = [(say(), say()) for _ in range(1_000)]
    began = time.process_time()
    assert not any(text_udf.reaches(a, b, 0.9) for a, b in pairs)
    assert time.process_time() - began < 0.5


def test_islands_of_one_task_don_t_touch(spark):
    """Rows of many documents and islands in one task, more than a slice: each island begins anew."""
    rows = [(d, i, "S0", "the very same line", 10_000 * i, 10_000 * i + 100) for d in range(40) for i in range(10)]
    rows += [(d, 100, "S0", "the very same line", 90_200, 92_000) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, idx bigint, speaker string, text string, t0 bigint, t1 bigint").coalesce(1)
    assert sequences.drop_redundant(df).where("idx = 100").count() == 0 and sequences.drop_redundant(df).count() == 400
    got = sequences.clean(df).collect()
    assert len(got) == 400 and {r.text for r in got} == {"The very same line"}


def test_python_holds_a_slice_of_a_batch(spark, monkeypatch):
    """a function over a batch never sees more rows than a slice at a time, and keeps their order."""
    import pyarrow as pa
    from pyspark.sql import types as T

    n = 3 * text_udf.SLICE + 5
    double = text_udf.by_slices(lambda x, y: None if x is None else x + y, T.LongType(), pa.int64())
    df = spark.range(n).coalesce(1).selectExpr("id", "if(id % 7 = 0, null, id) AS x", "1L AS y")
    assert [r.z for r in df.select(double("x", "y").alias("z")).collect()] == [None if k % 7 == 0 else k + 1 for k in range(n)]
    assert df.where("id < 0").select(double("x", "y").alias("z")).collect() == []


@pytest.mark.parametrize("words", ["a b a b c", "a b c d e", "x a b a b a b", "a a b b", "a b c a b c a b"])
def test_repeats_are_found_where_two_words_come_again(words):
    want = {"a b a b c": "a b c", "a b c d e": "a b c d e", "x a b a b a b": "x a b", "a a b b": "a a b b", "a b c a b c a b": "a b c a b"}
    assert text_udf.local_repeats(words) == want[words]


def test_a_line_is_cleaned_once(spark):
    """the plan holds one Python step, not one more for the filter and two for a join."""
    from vocalis.plans import composites  # noqa: F401
    from vocalis.plans.registry import QUERIES

    plan = QUERIES["pipe_postprocess"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
