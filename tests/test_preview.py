"""Unified diffs against brute force and the standard library; previews within their limit."""

from __future__ import annotations

import difflib
import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vocalis.functions import preview

TEXTS = st.lists(st.sampled_from(["a", "b", "c", "", "dd", "-x", "+y", " z", "@@ -1 +1 @@"]), max_size=14).map("\n".join)


@given(TEXTS, TEXTS, st.integers(0, 4))
def test_a_patch_leads_back(a, b, context):
    d = preview.unified(a, b, context=context)
    assert preview.patched(a, d) == b
    assert (d == "") == (a == b)


@given(TEXTS, TEXTS, st.integers(1, 4))
def test_diffs_are_those_of_the_standard_library(a, b, context):
    want = list(difflib.unified_diff(a.split("\n"), b.split("\n"), "source", "preview", lineterm="", n=context))
    assert preview.unified(a, b, context=context) == "\n".join(want)


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
    return best[-1][-1]


def test_edits_of_unlike_lines_are_the_fewest():
    """Where a text's lines differ from one another, a diff after single edits keeps a longest common subsequence."""
    r = random.Random(1)
    for _ in range(100):
        a = [f"line {k}" for k in range(r.randint(1, 30))]
        b = [x + "!" if r.random() < 0.2 else x for x in a if r.random() > 0.1]
        d = preview.unified("\n".join(a), "\n".join(b)).split("\n")[2:]
        gone = sum(x.startswith("-") for x in d)
        assert gone == len(a) - lcs(a, b) if b else True


def test_beyond_the_budget_a_diff_is_coarse_but_right():
    a, b = "\n".join(["head", *["same"] * 3000, "x", *["same"] * 2000, "tail"]), "\n".join(["head", *["same"] * 2500, "y", *["same"] * 2600, "tail"])
    began = time.time()
    d = preview.unified(a, b, budget=1000)
    assert time.time() - began < 5
    assert preview.patched(a, d) == b and d.count("@@ -") == 1


def test_a_diff_of_another_text():
    with pytest.raises(ValueError, match="differs"):
        preview.patched("q\nb\nc", preview.unified("a\nb\nc", "a\nb\nd"))


def test_previews(spark):
    df = spark.createDataFrame([(1, "The cat\nand the dog\n"), (2, None), (3, "nothing"), (4, "a" * 40 + "b")], "id int, text string")
    got = {r.id: r.p for r in df.select("id", preview.preview(df.text, r"\bthe\b", "a").alias("p")).collect()}
    assert (got[1].hits, got[1].text, got[1].error) == (2, "a cat\nand a dog\n", None)
    assert got[1].diff == "--- source\n+++ preview\n@@ -1,3 +1,3 @@\n-The cat\n-and the dog\n+a cat\n+and a dog\n "
    assert got[2] is None or got[2].hits is None
    assert (got[3].hits, got[3].diff) == (0, "")
    slow = {r.id: r.p for r in df.select("id", preview.preview(df.text, r"(a|aa)+$", "x", limit_ms=50).alias("p")).collect()}
    assert slow[4].error == "more than 50 ms" and slow[3].hits == 0
    bad = df.where("id = 3").select(preview.preview(df.text, "[", "x").alias("p")).first().p
    assert bad.error.startswith("no pattern") and bad.text is None
