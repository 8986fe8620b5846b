"""a first letter whose upper case is several letters becomes one capital, as in DuckDB."""

from __future__ import annotations

import duckdb

from vocalis.functions import text
from vocalis.plans import texts  # noqa: F401
from vocalis.plans.registry import ORACLES


def test_first_letters_as_in_sql(spark):
    rows = [(k, t) for k, t in enumerate(["ßheit nicht. Und", "ᾳ alpha", "ŉ", "ﬁn. x", "ä", "", "öl", "ΐ", "ab.\n", "a... b"])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = dict(con.execute(ORACLES["fn_title"]).fetchall())
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.t for r in df.select("doc_id", text.title(df.text).alias("t")).collect()} == want
    assert want[0] == "ẞheit nicht"
    got = [tuple(r) for r in df.where("doc_id = 0").select(text.sentence_case(df.text), text.sanitize(df.text)).collect()]
    assert got == [("ẞheit nicht. Und", "ẞheit nicht. Und")]
