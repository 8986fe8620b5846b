"""Job log and incremental processing."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from vocalis.operators import control, incremental, memo
from vocalis.plans.registry import query
from vocalis.sources import files
from vocalis.sources.adapters import JOBS, jobs, table
from vocalis.streaming import states


@query("jobs_by_status", f"WITH {JOBS} SELECT action, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs GROUP BY action")
def jobs_by_status(spark, sf_dir):
    names = ["pending", "running", "succeeded", "failed"]
    return jobs(spark, sf_dir).groupBy("action").pivot("status", names).count().fillna(0, names)


@query("jobs_list", f"WITH {JOBS} SELECT id, doc, action, status FROM jobs ORDER BY id DESC LIMIT 100")
def jobs_list(spark, sf_dir):
    return jobs(spark, sf_dir).select("id", "doc", "action", "status").orderBy(F.desc("id")).limit(100)


@query("jobs_last_per_doc", f"WITH {JOBS} SELECT doc, max(id) AS id, arg_max(status, id) AS status FROM jobs WHERE action IN ('click', 'view') GROUP BY doc")
def jobs_last_per_doc(spark, sf_dir):
    return control.latest(jobs(spark, sf_dir).where(F.col("action").isin("click", "view")).select("doc", "id", "status"))


@query("jobs_latest_state", f"WITH {JOBS}, l AS (SELECT id % 500 AS job, id AS seq, CASE WHEN id % 3 = 0 THEN status END AS status, CASE WHEN id % 2 = 0 THEN duration_ms END AS duration_ms FROM jobs) SELECT job, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status, arg_max(duration_ms, seq) FILTER (WHERE duration_ms IS NOT NULL) AS duration_ms FROM l GROUP BY job")
def jobs_latest_state(spark, sf_dir):
    log = jobs(spark, sf_dir).select((F.col("id") % 500).alias("job"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.col("status")).alias("status"), F.when(F.col("id") % 2 == 0, F.col("duration_ms")).alias("duration_ms"))
    return incremental.latest_state(log, "job", "seq", ["status", "duration_ms"])


@query("inc_pending", f"WITH {JOBS}, st AS (SELECT id, status, id % 4 AS retries FROM jobs WHERE status <> 'pending') SELECT j.id, coalesce(st.status, 'pending') AS status FROM jobs j LEFT JOIN st USING (id) WHERE coalesce(st.status, 'pending') IN ('pending', 'running') OR (st.status = 'failed' AND retries < 2)")
def inc_pending(spark, sf_dir):
    j = jobs(spark, sf_dir)
    state = j.where("status <> 'pending'").select("id", "status", (F.col("id") % 4).alias("retries"))
    return incremental.pending(j.select("id"), state, 2)


@query("inc_changed_docs", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR contains(text, '  ')")
def inc_changed_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    # what was seen before: the labelled documents, with single blanks
    single = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.regexp_replace("text", " {2,}", " ").cast("binary"), 256).alias("hash"))
    done = single.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return incremental.changed(d, done)


@query("inc_stamp_skip", "SELECT d.doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND d.source <> 'src3')")
def inc_stamp_skip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("source") == "src3", "new").otherwise("same").alias("sha"))
    stamps = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("same").alias("sha")).join(d.select("doc_id", "source"), "doc_id")
    return incremental.unstamped(d, stamps).select("doc_id", "source")


_WINDOW_EVENTS = (("start", 0, 100), ("error", 1, 45), ("start", 2, 45), ("error", 3, 20), ("start", 4, 20), ("error", 5, 20))
STATES_SQL = """WITH s AS (SELECT conv_id AS doc_id, turn AS window_id, (conv_id * 31 + turn * 17) % 100 AS conf, turn * 600 AS t FROM conversations),
e AS (SELECT *, t + CASE WHEN conf < 20 THEN 300 WHEN conf < 45 THEN 180 WHEN conf < 90 THEN 60 ELSE 0 END AS last FROM s), m AS (SELECT max(last) - 600 AS mark FROM e)
SELECT doc_id, window_id, CASE WHEN conf < 20 THEN 'FAILED' WHEN conf < 90 THEN 'DONE' WHEN t + 450 < mark THEN 'RETRY' ELSE 'IN_PROGRESS' END AS status, (CASE WHEN conf < 20 THEN 3 WHEN conf < 45 THEN 2 ELSE 1 END)::INT AS attempts FROM e, m"""


@query("stream_window_states", STATES_SQL)
def stream_window_states(spark, sf_dir):
    """Segments as windows that a stream works on, ten minutes apart: the less their confidence, the more attempts fail; some are never heard of again."""
    path = f"{files.shared_folder(spark)}/states-{uuid.uuid4().hex}"
    read = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parque?")  # a pattern: the table may be a file or a folder
    conf, turn = (F.col("conv_id") * 31 + F.col("turn") * 17) % 100, F.col("turn")
    failing = [F.when(conf < below, F.struct(F.lit(name).alias("event"), F.lit(60 * minute).alias("after"))) for name, minute, below in _WINDOW_EVENTS]
    ending = [F.when((conf >= 20) & (conf < 45), F.struct(F.lit("ok").alias("event"), F.lit(180).alias("after"))), F.when((conf >= 45) & (conf < 90), F.struct(F.lit("ok").alias("event"), F.lit(60).alias("after")))]
    events = read.select(F.col("conv_id").alias("doc_id"), turn.alias("window_id"), F.inline(F.array_compact(F.array(*failing, *ending))))
    events = events.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("window_id") * 600 + F.col("after")))
    states.follow(events.select("doc_id", "window_id", "ts", "event"), path, retries=2, patience_ms=450_000).awaitTermination()
    return states.states(spark, path).select("doc_id", "window_id", "status", "attempts")


def _folded(resource: dict, rows: pa.Table) -> pa.Table:
    """A stand-in for a model: words without the letters that it doesn't know; it gives up on texts whose length is a multiple of eleven."""
    texts = rows.column("text").to_pylist()
    if any(t is not None and len(t) % 11 == 0 for t in texts):
        raise ValueError("no alignment")
    out = [None if t is None else t.translate(resource) for t in texts]
    return pa.table({"better": pa.array(out, pa.string()), "letters": pa.array([None if t is None else len(t) for t in out], pa.int64())})


@query("ux_backend_rows", "SELECT conv_id AS doc_id, turn AS idx, CASE WHEN length(text) % 11 = 0 THEN text ELSE translate(text, 'xyz', '') END AS better, CASE WHEN length(text) % 11 <> 0 THEN length(translate(text, 'xyz', '')) END::BIGINT AS letters, CASE WHEN length(text) % 11 = 0 THEN 'ValueError: no alignment' END AS error FROM conversations")
def ux_backend_rows(spark, sf_dir):
    """Every segment through a backend that fails on some: each keeps its row, a failed one its own text."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")
    backend = memo.Backend("folded", "1", ("text",), "better string, letters bigint", lambda: str.maketrans("", "", "xyz"), _folded)
    out = memo.apply(c, backend, f"{files.shared_folder(spark)}/backend-{uuid.uuid4().hex}", fallback={"better": "text"})
    return out.select("doc_id", "idx", "better", "letters", "error")


GRAPH_SQL = r"""WITH c AS (SELECT conv_id, turn, text, regexp_extract_all(text, '\S+') AS ws FROM conversations), d AS (SELECT conv_id AS doc_id, sum(len(ws))::BIGINT AS words, bool_or(length(text) % 3 = 0) AS changed FROM c GROUP BY conv_id)
SELECT doc_id, words, changed AS computed_words FROM d"""


@query("inc_stage_graph", GRAPH_SQL)
def inc_stage_graph(spark, sf_dir):
    """Words of each document by a graph of stages that has run before, when some texts had one mark more; and which it computed again."""
    path = f"{files.shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")
    before = c.withColumn("text", F.when(F.length("text") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    stages = [
        memo.Stage("tokens", ("texts",), lambda t: t.select("doc_id", "idx", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n")), "doc_id bigint, idx bigint, n bigint"),
        memo.Stage("words", ("tokens",), lambda t: t.groupBy("doc_id").agg(F.sum("n").alias("words")), "doc_id bigint, words bigint"),
    ]
    memo.run(spark, path, stages, {"texts": before})
    out, _ = memo.run(spark, path, stages, {"texts": c})
    again = spark.read.parquet(f"{path}/tokens/keys/*").groupBy("doc_id").agg((F.count_distinct("run") > 1).alias("computed_words"))
    return out["words"].join(again, "doc_id").select("doc_id", "words", "computed_words")
