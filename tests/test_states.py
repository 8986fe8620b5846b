"""The stream of window states: rules, timers, restarts, and what a batch that runs twice leaves."""

from __future__ import annotations

import itertools
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vocalis.streaming import states

START = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "doc_id bigint, window_id bigint, ts timestamp, event string"


def at(minutes):
    return (START + timedelta(minutes=minutes)).replace(tzinfo=None)


def write(spark, folder, rows):
    spark.createDataFrame([(d, w, at(m), e) for d, w, m, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, **options):
    q = states.follow(spark.readStream.schema(SCHEMA).parquet(folder), out, **options)
    assert q.awaitTermination(240)
    assert q.exception() is None


def got(spark, out, **options):
    return {(r.doc_id, r.window_id): (r.status, r.attempts) for r in states.states(spark, out, **options).collect()}


def test_rules():
    def after(*events):
        s = ("PENDING", 0, 0, 0)
        for k, e in enumerate(events):
            s = states.step(s, e, k, retries=1, patience=100)
        return s[:2]

    assert after("queued") == ("PENDING", 0)
    assert after("start") == ("IN_PROGRESS", 1)
    assert after("start", "start") == ("IN_PROGRESS", 1)
    assert after("start", "error") == ("RETRY", 1)
    assert after("start", "error", "error") == ("RETRY", 1)
    assert after("start", "error", "start", "ok") == ("DONE", 2)
    assert after("start", "error", "start", "silence") == ("FAILED", 2)
    assert after("start", "error", "start", "error", "start") == ("FAILED", 2)
    assert after("start", "error", "start", "error", "ok") == ("DONE", 2)
    assert after("ok", "error", "start") == ("DONE", 1)


def test_every_sequence_ends_in_a_known_state():
    for events in itertools.product(("queued", "start", "error", "ok", "silence"), repeat=5):
        s = ("PENDING", 0, 0, 0)
        for k, e in enumerate(events):
            s = states.step(s, e, k, retries=1, patience=3)
            assert s[0] in ("PENDING", "IN_PROGRESS", "DONE", "RETRY", "FAILED") and 0 <= s[1] <= 2
        assert ("ok" in events) == (s[0] == "DONE")


@pytest.fixture(scope="module")
def batches():
    return [
        [(1, 0, 0, "queued"), (1, 1, 0, "start"), (1, 2, 1, "start"), (1, 2, 2, "error"), (2, 0, 0, "start"), (2, 0, 3, "ok"), (3, 0, 0, "start")],
        [(1, 2, 20, "start"), (1, 2, 21, "error"), (1, 0, 22, "start"), (2, 1, 23, "start"), (4, 0, 60, "queued")],
        [(1, 2, 61, "start"), (1, 2, 62, "error"), (1, 0, 61, "ok"), (2, 1, 59.5, "error"), (5, 0, 130, "queued")],
        [(2, 1, 131, "start"), (2, 1, 133, "ok"), (3, 0, 134, "start"), (6, 0, 200, "queued")],
    ]


def test_restarts_give_what_one_run_gives(spark, tmp_path, batches):
    """A stream that stops after each batch, and goes on from its checkpoint; and one that takes the same batches in one run.

    The ok of (1, 0) comes after its attempt was given up, by the timer of an empty batch or by its own time.
    """
    for rows in batches:
        write(spark, str(tmp_path / "in"), rows)
        run(spark, str(tmp_path / "in"), str(tmp_path / "steps"), retries=2, patience_ms=600_000, late="1 minute")
    whole = states.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "once"), retries=2, patience_ms=600_000, late="1 minute")
    assert whole.awaitTermination(240)
    want = {(1, 0): ("DONE", 1), (1, 1): ("RETRY", 1), (1, 2): ("FAILED", 3), (2, 0): ("DONE", 1), (2, 1): ("DONE", 2), (3, 0): ("RETRY", 2), (4, 0): ("PENDING", 0), (5, 0): ("PENDING", 0), (6, 0): ("PENDING", 0)}
    assert got(spark, str(tmp_path / "steps")) == want
    assert got(spark, str(tmp_path / "once")) == want
    fast = got(spark, str(tmp_path / "steps"), fail_fast=True)
    assert fast[1, 1] == ("ABORTED", 1) and fast[2, 0] == ("DONE", 1) and fast[3, 0] == ("RETRY", 2)
    last = states.states(spark, str(tmp_path / "steps"))
    assert {(r.doc_id, r.window_id) for r in states.to_run(last).collect()} == {(1, 1), (3, 0), (4, 0), (5, 0), (6, 0)}
    assert {(r.doc_id, r.window_id) for r in states.to_run(last, only_failed=True).collect()} == {(1, 2)}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path, batches):
    """The sink has written, but the batch isn't committed: after the restart it is written again, to the same folder."""
    folder, out = str(tmp_path / "in"), tmp_path / "out"
    for rows in batches[:2]:
        write(spark, folder, rows)
        run(spark, folder, str(out), late="1 minute")
    before, rows = got(spark, str(out)), states.states(spark, str(out)).count()
    commits = sorted((p for p in (out / "checkpoint" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    run(spark, folder, str(out), late="1 minute")
    assert got(spark, str(out)) == before and states.states(spark, str(out)).count() == rows
    changes = spark.read.schema(f"{states.CHANGE}, batch bigint").option("basePath", str(out / "changes")).parquet(str(out / "changes"))
    assert changes.groupBy("batch", "doc_id", "window_id").count().where(F.col("count") > 1).count() == 0


def test_neighbouring_windows_share_a_key(spark, tmp_path):
    """One key for the windows of neighbouring documents: events of some leave the others' states and timers alone."""
    ids = [(d, w) for d in (None, -1, 0, 1, 2, 15, 16) for w in (None, -1, 0, 1, 15, 16)]
    at_batch = [
        [(d, w, 0, "start") for d, w in ids] + [(9, 9, 30, "queued")],
        [(0, 1, 31, "ok"), (2, None, 31, "start"), (9, 9, 32, "queued")],
        [(9, 9, 60, "queued"), (1, 15, 61, "start")],
    ]
    for rows in at_batch:
        spark.createDataFrame([(d, w, at(m), e) for d, w, m, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = states.follow(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), retries=2, patience_ms=600_000, late="1 minute")
        assert q.awaitTermination(240) and q.exception() is None
    want = {(d, w): ("RETRY", 1) for d, w in ids} | {(9, 9): ("PENDING", 0), (0, 1): ("DONE", 1), (2, None): ("RETRY", 2), (1, 15): ("IN_PROGRESS", 2)}
    assert got(spark, str(tmp_path / "out")) == want
    keys = {tuple(None if k is None else k // 16 for k in i) for i in want}
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == len(keys) < len(want)
