"""The state of each window of each document, kept by a stream of what happens to it.

A window is PENDING until it starts, then IN_PROGRESS. It ends DONE, or an attempt fails: RETRY while attempts are left, else FAILED. An
attempt that says nothing for ``patience`` (in event time) has failed, too; a timer sees to that. DONE is final, whatever comes later.
Changes go to a table by micro-batch: a batch that runs again after a restart replaces its own folder, so that nothing counts twice.

A key of the stream costs Python milliseconds however little it holds, so the windows of DOCS neighbouring documents, WINDOWS of each,
share one; each keeps a state and a deadline of its own. A long document still spreads over tasks. A checkpoint of one layout can't be
continued with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "doc_id bigint, window_id bigint, status string, attempts int, at bigint"
STATE = "windows array<struct<slot:int,status:string,attempts:int,deadline:bigint,at:bigint,due:bigint>>"
#: A key's share: so many documents whose ids follow one another, so many windows of each. Powers of two.
DOCS, WINDOWS = 16, 16
PENDING, IN_PROGRESS, DONE, RETRY, FAILED, ABORTED = "PENDING", "IN_PROGRESS", "DONE", "RETRY", "FAILED", "ABORTED"
#: What happens to a window, in the order in which events of one moment count.
EVENTS = ("queued", "start", "error", "ok")


def step(state: tuple[str, int, int, int], event: str, at: int, retries: int, patience: int) -> tuple[str, int, int, int]:
    """The next (status, attempts, deadline, at). ``event`` is one of EVENTS, or ``silence`` when the deadline has passed."""
    status, attempts, deadline, last = state
    last = max(last, at)
    if status == DONE or event == "queued":
        return status, attempts, deadline, last
    if event == "ok":  # a success after the attempt was given up counts, too
        return DONE, max(attempts, 1), 0, last
    if event == "start":
        return (status, attempts, deadline, last) if status == FAILED else (IN_PROGRESS, attempts + (status != IN_PROGRESS), at + patience, last)
    if status not in (IN_PROGRESS, PENDING):
        return status, attempts, deadline, last  # an attempt fails once
    attempts = max(attempts, 1)
    return (RETRY if attempts <= retries else FAILED), attempts, 0, last


def changes(events: DataFrame, retries: int = 2, patience_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """From a stream (doc_id, window_id, ts, event): a row of CHANGE for each window that a micro-batch or a timer changed.

    Events of one micro-batch are taken in the order of their time; ones of one moment in that of EVENTS. Events behind the watermark
    are dropped: what they could change has been decided by a timer. In a micro-batch with events of a window its timer doesn't count.
    """
    rank, patience = {e: k for k, e in enumerate(EVENTS)}, patience_ms

    def heard(now: tuple[str, int, int, int], rows: list[tuple[int, str]]) -> tuple[str, int, int, int]:
        for at, _, event in sorted((int(t), rank[e], e) for t, e in rows if e in rank):
            if now[0] == IN_PROGRESS and now[2] < at:  # silence came before this event
                now = step(now, "silence", now[2], retries, patience)
            now = step(now, event, at, retries, patience)
        return now

    def work(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, came, changed = state.getCurrentWatermarkMs(), {}, []
        known = {slot: (tuple(now), due) for slot, *now, due in state.get[0]} if state.exists else {}
        if not state.hasTimedOut:
            for b in batches:
                for slot, at, event in zip(b["slot"].tolist(), b["ms"].tolist(), b["event"].tolist(), strict=True):
                    came.setdefault(int(slot), []).append((at, event))
        for slot in sorted(known.keys() | came.keys()):
            before, due = known.get(slot, (None, 0))
            now = before or (PENDING, 0, 0, 0)
            if slot in came:
                now = heard(now, came[slot])
                due = max(now[2], mark + 1)
            elif now[0] == IN_PROGRESS and due < mark:
                now = step(now, "silence", now[2], retries, patience)
            known[slot] = now, due
            if now != before:
                doc, window = (None if pd.isna(k) else int(k) * n + at for k, n, at in zip(key, (DOCS, WINDOWS), divmod(slot, WINDOWS), strict=True))
                changed.append((doc, window, now[0], now[1], now[3]))
        state.update(([(slot, *now, due) for slot, (now, due) in known.items()],))
        open_ = [due for now, due in known.values() if now[0] == IN_PROGRESS]
        if open_:
            state.setTimeoutTimestamp(min(open_))
        if changed:
            yield pd.DataFrame(changed, columns=["doc_id", "window_id", "status", "attempts", "at"])

    def at(name: str, n: int) -> tuple[Column, Column]:
        """The block of an id, floored for negative ones too, and its place there."""
        id_ = F.col(name).cast("long")
        return F.shiftright(id_, n.bit_length() - 1), F.coalesce(id_.bitwiseAND(n - 1), F.lit(0))

    (doc_block, doc), (window_block, window) = at("doc_id", DOCS), at("window_id", WINDOWS)
    slot = (doc * WINDOWS + window).cast("int")
    timed = events.withWatermark("ts", late).select(doc_block.alias("doc_block"), window_block.alias("window_block"), slot.alias("slot"), "ts", F.unix_millis("ts").alias("ms"), "event")
    return timed.groupBy("doc_block", "window_block").applyInPandasWithState(work, CHANGE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def follow(events: DataFrame, path: str, once: bool = True, **options: Any):
    """Starts the stream: changes go to ``path``/changes, progress to ``path``/checkpoint. ``once``: takes what is there, and ends."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id:012d}")

    out = changes(events, **options).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint")
    return (out.trigger(availableNow=True) if once else out).start()


def states(spark: SparkSession, path: str, fail_fast: bool = False) -> DataFrame:
    """(doc_id, window_id, status, attempts, at) as the last change of each window left it.

    With ``fail_fast`` the windows of a document with a FAILED one are ABORTED unless they are DONE or FAILED themselves.
    """
    kept = spark.read.schema(f"{CHANGE}, batch bigint").option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    last = kept.groupBy("doc_id", "window_id").agg(F.max_by(F.struct("status", "attempts", "at"), "batch").alias("s")).select("doc_id", "window_id", "s.*")
    if not fail_fast:
        return last
    broken = last.where(F.col("status") == FAILED).select("doc_id").distinct().withColumn("broken", F.lit(True))
    ended = F.col("status").isin(DONE, FAILED)
    return last.join(broken, "doc_id", "left").withColumn("status", F.when(F.col("broken") & ~ended, ABORTED).otherwise(F.col("status"))).drop("broken")


def to_run(states_: DataFrame, only_failed: bool = False) -> DataFrame:
    """The windows to start: those that are pending or may retry, or only those that failed."""
    return states_.where(F.col("status") == FAILED if only_failed else F.col("status").isin(PENDING, RETRY))
