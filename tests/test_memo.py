"""Model backends lose no row and call none twice; a stage graph computes only what changed."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from vocalis.operators import memo


def backend(log: str, bad: str = "bad", version: str = "1", rows: int = 4) -> memo.Backend:
    """Capitals; raises on texts with ``bad``, and writes down what it is called with."""

    def load():
        with open(f"{log}/loads", "a") as f:
            f.write("x")
        return {"suffix": "!"}

    def call(resource, table):
        texts = table.column("text").to_pylist()
        if any(t is not None and bad in t for t in texts):
            raise RuntimeError(f"cannot hear {bad}")
        with open(f"{log}/calls", "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return pa.table({"better": pc.binary_join_element_wise(pc.utf8_upper(table.column("text")), resource["suffix"], ""), "length": pa.array([None if t is None else len(t) for t in texts], pa.int64())})

    return memo.Backend("capitals", version, ("text",), "better string, length bigint", load, call, rows)


def calls(log) -> list[str]:
    path = log / "calls"
    return path.read_text().splitlines() if path.exists() else []


def test_a_backend_that_fails_on_some_rows_loses_none(spark, tmp_path):
    texts = ["one", "two", "bad three", "four", "one", None, "five", "very bad", "six", "seven"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    got = {r.id: (r.better, r.length, r.error) for r in memo.apply(rows, backend(str(tmp_path)), str(tmp_path / "m"), fallback={"better": "text"}).collect()}
    for k, t in enumerate(texts):
        if t is not None and "bad" in t:
            assert got[k] == (t, None, "RuntimeError: cannot hear bad")
        else:
            assert got[k] == ((t.upper() + "!", len(t), None) if t is not None else (None, None, None))
    assert calls(tmp_path).count("one") == 1


def test_what_succeeded_is_not_called_again(spark, tmp_path):
    path = str(tmp_path / "m")
    df = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    memo.apply(df(["a", "b", "bad"]), backend(str(tmp_path)), path).collect()
    before = len(calls(tmp_path))
    again = memo.apply(df(["b", "a", "c", "bad"]), backend(str(tmp_path)), path)
    assert {r.text: r.better for r in again.collect()} == {"a": "A!", "b": "B!", "c": "C!", "bad": None}
    assert calls(tmp_path)[before:] == ["c"]
    mended = memo.apply(df(["bad", "a"]), backend(str(tmp_path), bad="worse"), path)  # a failed row is tried again
    assert {r.text: (r.better, r.error) for r in mended.collect()} == {"a": ("A!", None), "bad": ("BAD!", None)}
    memo.apply(df(["a"]), backend(str(tmp_path), version="2"), path).collect()
    memo.apply(df(["a"]), backend(str(tmp_path)), path, settings={"beam": 5}).collect()
    assert calls(tmp_path)[before:] == ["c", "bad", "a", "a"]
    assert memo.apply(df([]), backend(str(tmp_path)), path).count() == 0


def test_a_backend_loads_once_in_a_worker(spark, tmp_path):
    rows = spark.range(64).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).coalesce(1)
    assert memo.apply(rows, backend(str(tmp_path), version=str(tmp_path)), str(tmp_path / "m")).where("error is null").count() == 64
    assert len((tmp_path / "loads").read_text()) <= 2


def test_a_backend_that_returns_too_few_rows(spark, tmp_path):
    short = memo.Backend("short", "1", ("text",), "out string", dict, lambda r, t: pa.table({"out": t.column("text").slice(1)}))
    got = memo.apply(spark.createDataFrame([("a",), ("b",)], "text string"), short, str(tmp_path / "m")).collect()
    assert len(got) == 2 and all("rows" in r.error for r in got)


def graph(seen: list[str], factor: int = 1) -> list[memo.Stage]:
    def counted(name, f):
        def compute(*tables):
            seen.append(name)
            return f(*tables)

        return compute

    return [
        memo.Stage("total", ("words", "marks"), counted("total", lambda w, m: w.groupBy("doc_id").agg(F.sum("n").alias("n")).join(m, "doc_id", "left").select("doc_id", (F.col("n") * 10 + F.coalesce("m", F.lit(0))).alias("total"))), "doc_id bigint, total bigint"),
        memo.Stage("words", ("texts",), counted("words", lambda t: t.select("doc_id", "idx", (F.size(F.split("text", " ")) * factor).cast("long").alias("n"))), "doc_id bigint, idx bigint, n bigint", settings={"factor": factor}),
        memo.Stage("marks", ("texts",), counted("marks", lambda t: t.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit("[.]"))).cast("long").alias("m"))), "doc_id bigint, m bigint"),
    ]


def test_only_changed_documents_are_computed(spark, tmp_path):
    path = str(tmp_path / "g")
    df = lambda rows: spark.createDataFrame(rows, "doc_id bigint, idx bigint, text string")
    rows = [(d, i, f"word {d} . {i}") for d in range(6) for i in range(3)]
    seen: list[str] = []
    out, report = memo.run(spark, path, graph(seen), {"texts": df(rows)})
    want = {r.doc_id: r.total for r in out["total"].collect()}
    assert want == {d: 12 * 10 + 3 for d in range(6)}
    assert report == {n: {"computed": 6, "reused": 0} for n in ("words", "marks", "total")}

    seen.clear()
    out, report = memo.run(spark, path, graph(seen), {"texts": df(rows[::-1])})
    assert seen == [] and report["total"] == {"computed": 0, "reused": 6} and {r.doc_id: r.total for r in out["total"].collect()} == want

    rows[4] = (1, 1, "one more word . .")  # words and marks of document 1 change
    rows[7] = (2, 1, "other 9 . 1")  # as many words and marks as before: the last stage sees nothing new
    out, report = memo.run(spark, path, graph(seen), {"texts": df(rows)})
    assert report == {"words": {"computed": 2, "reused": 4}, "marks": {"computed": 2, "reused": 4}, "total": {"computed": 1, "reused": 5}}
    assert {r.doc_id: r.total for r in out["total"].collect()} == want | {1: 13 * 10 + 4}

    _, report = memo.run(spark, path, graph(seen, 2), {"texts": df(rows)})
    assert report["words"]["computed"] == 6 and report["marks"]["computed"] == 0 and report["total"]["computed"] == 6
    _, report = memo.run(spark, path, graph(seen), {"texts": df(rows)}, force={"marks"})
    assert report["marks"]["computed"] == 6 and report["words"]["computed"] == report["total"]["computed"] == 0
    out, report = memo.run(spark, path, graph(seen, 3), {"texts": df(rows[:9])}, only={"marks"})
    assert report["words"] == {"computed": 0, "reused": 0} and out["words"].count() == 0 and out["marks"].count() == 3


def test_a_run_that_stops_goes_on(spark, tmp_path):
    path, seen = str(tmp_path / "g"), []
    texts = spark.createDataFrame([(1, 0, "a b"), (2, 0, "c")], "doc_id bigint, idx bigint, text string")
    stages = graph(seen)
    broken = [memo.Stage("total", ("words", "marks"), lambda w, m: w.select("doc_id", F.raise_error(F.lit("stop")).cast("long").alias("total")), stages[0].schema), *stages[1:]]
    with pytest.raises(Exception, match="stop"):
        memo.run(spark, path, broken, {"texts": texts})
    seen.clear()
    out, report = memo.run(spark, path, stages, {"texts": texts})
    assert seen == ["total"] and report["total"] == {"computed": 2, "reused": 0} and out["total"].count() == 2


def test_graphs_that_cannot_run():
    s = lambda name, *after: memo.Stage(name, after, lambda *t: t[0], "doc_id bigint")
    with pytest.raises(ValueError, match="need each other"):
        memo.ordered([s("a", "b"), s("b", "a")], {"x"})
    with pytest.raises(ValueError, match="need each other"):
        memo.ordered([s("a", "missing")], {"x"})
    with pytest.raises(ValueError, match="differ"):
        memo.ordered([s("a", "x"), s("a", "x")], {"x"})
    assert [t.name for t in memo.ordered([s("c", "b"), s("b", "a", "x"), s("a", "x")], {"x"})] == ["a", "b", "c"]
