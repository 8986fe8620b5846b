"""Work that isn't done twice: models as row functions, and stages of a document pipeline, kept by the content that they saw.

A result is stored under a key: the hash of what went in, of the settings, and the version of the code. Rows and documents whose key is
known read the stored result; only the others are computed. Nothing has to be invalidated by hand: a stage's output is part of
the next stage's key. Each part of a store is written whole before anything names it, so a run that stops leaves what it finished.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.sources import files

KEY = "memo_key"


def content(columns: list[str]) -> Column:
    """A hash of the columns' values; null differs from any text, and a value's end from the next one's start."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def key_of(columns: list[str], version: str, settings: Mapping[str, Any] | None = None) -> Column:
    return F.sha2(F.concat(F.lit(json.dumps([version, settings or {}], sort_keys=True)), content(columns)), 256)


@dataclass(frozen=True)
class Backend:
    """A model as a function of rows.

    ``load`` makes what a worker process needs, once; ``call`` takes that and an Arrow table of ``inputs`` and returns one of
    ``outputs`` (a schema), as many rows in the same order. ``rows`` is how many rows a call gets at most.
    """

    name: str
    version: str
    inputs: tuple[str, ...]
    outputs: str
    load: Callable[[], Any]
    call: Callable[[Any, pa.Table], pa.Table]
    rows: int = 256


_loaded: dict[tuple[str, str], Any] = {}


def _resource(backend: Backend) -> Any:
    at = backend.name, backend.version
    if at not in _loaded:
        _loaded[at] = backend.load()
    return _loaded[at]


def _called(backend: Backend, table: pa.Table, names: list[str]) -> tuple[pa.Table | None, list[str | None]]:
    """The outputs of a table and each row's error. A call that fails is tried again by halves, so that only its bad rows fail."""
    try:
        out = backend.call(_resource(backend), table).select(names)
        if out.num_rows != table.num_rows:
            raise ValueError(f"{backend.name} returned {out.num_rows} rows for {table.num_rows}")
        return out, [None] * table.num_rows
    except Exception as e:  # whatever a model raises is that row's error
        if table.num_rows == 1:
            return None, [f"{type(e).__name__}: {e}"]
    half = table.num_rows // 2
    parts = [_called(backend, t, names) for t in (table.slice(0, half), table.slice(half))]
    made = [p if p is not None else None for p, _ in parts]
    if made[0] is None and made[1] is None:
        return None, [*parts[0][1], *parts[1][1]]
    schema = next(m.schema for m in made if m is not None)
    filled = [m if m is not None else pa.table({f.name: pa.nulls(len(e), f.type) for f in schema}) for m, (_, e) in zip(made, parts, strict=True)]
    return pa.concat_tables([f.cast(schema) for f in filled]), [*parts[0][1], *parts[1][1]]


def _compute(rows: DataFrame, backend: Backend) -> DataFrame:
    """(memo_key, outputs, error) of rows with memo_key and the inputs."""
    names = [f.split()[0] for f in backend.outputs.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, backend.rows):
                table = pa.Table.from_batches([batch.slice(at, backend.rows)])
                out, errors = _called(backend, table.select(list(backend.inputs)), names)
                columns = [out.column(n).combine_chunks() if out is not None else pa.nulls(table.num_rows) for n in names]
                yield from pa.table([table.column(KEY).combine_chunks(), *columns, pa.array(errors, pa.string())], [KEY, *names, "error"]).cast(wanted).to_batches()

    schema = f"{KEY} string, {backend.outputs}, error string"
    spark = rows.sparkSession
    wanted = spark.createDataFrame([], schema).toArrow().schema
    return rows.select(KEY, *backend.inputs).mapInArrow(work, schema)


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    names = [n for n in files.names(spark, path) if not n.endswith(".tmp")]
    done = [f"{path}/{n}" for n in names if files.exists(spark, f"{path}/{n}/_SUCCESS")]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def apply(rows: DataFrame, backend: Backend, path: str, settings: Mapping[str, Any] | None = None, fallback: Mapping[str, str] | None = None) -> DataFrame:
    """rows with the backend's outputs and ``error``; each distinct input is called once, and never again once it has succeeded.

    A row on which the backend fails keeps its place: its outputs are null, or the row's own column that ``fallback`` names for an
    output, and ``error`` says why. Failed inputs aren't stored, so the next run tries them again.
    """
    spark = rows.sparkSession
    names = [f.split()[0] for f in backend.outputs.split(", ")]
    keyed = rows.withColumn(KEY, key_of(list(backend.inputs), f"{backend.name} {backend.version}", settings))
    known = _parts(spark, path, f"{KEY} string, {backend.outputs}, error string")
    fresh = keyed.select(KEY, *backend.inputs).dropDuplicates([KEY]).join(known.where("error is null").select(KEY), KEY, "left_anti")
    _compute(fresh, backend).write.parquet(f"{path}/{uuid.uuid4().hex}")
    every = _parts(spark, path, f"{KEY} string, {backend.outputs}, error string")
    # a success is worth more than an error of an earlier or a parallel run
    kept = every.groupBy(KEY).agg(F.min_by(F.struct(*names, "error"), F.col("error").isNotNull()).alias("kept"))
    out = keyed.join(kept, KEY, "left")
    filled = [F.coalesce(F.col(f"kept.{n}"), F.when(F.col("kept.error").isNotNull(), F.col(fallback[n]))).alias(n) if n in (fallback or {}) else F.col(f"kept.{n}").alias(n) for n in names]
    return out.select(*[c for c in rows.columns if c not in names], *filled, F.col("kept.error").alias("error"))


@dataclass(frozen=True)
class Stage:
    """A step of a document pipeline: ``compute`` takes the tables of ``after``, each with doc_id, and returns one with doc_id."""

    name: str
    after: tuple[str, ...]
    compute: Callable[..., DataFrame]
    schema: str
    version: str = "1"
    settings: Mapping[str, Any] = field(default_factory=dict)


def _digest(df: DataFrame) -> DataFrame:
    """(doc_id, h): a hash of a document's rows, whatever their order."""
    return df.select("doc_id", content(sorted(df.columns)).alias("row")).groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ","), 256).alias("h"))


def ordered(stages: list[Stage], sources: set[str]) -> list[Stage]:
    """The stages, each behind those that it needs; a name that is missing, given twice or needs itself is an error."""
    names = [s.name for s in stages]
    if len(set(names)) < len(names) or set(names) & sources:
        raise ValueError("names of stages must differ")
    out: list[Stage] = []
    while len(out) < len(stages):
        have = sources | {s.name for s in out}
        ready = [s for s in stages if s.name not in have and set(s.after) <= have]
        if not ready:
            raise ValueError(f"stages that need each other, or what isn't there: {sorted(set(names) - have)}")
        out += ready
    return out


def run(spark: SparkSession, path: str, stages: list[Stage], sources: Mapping[str, DataFrame], only: set[str] | None = None, force: set[str] = frozenset()) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]]]:
    """The tables of all stages, and how many documents each stage computed and reused.

    A document is computed where its key is new: the hash of its rows in the stage's inputs, the settings, the version. ``only`` names
    the stages that may compute; the others give what is stored for the same key. ``force`` names stages that compute everything.
    """
    tables, report = dict(sources), {}
    for s in ordered(stages, set(sources)):
        place = f"{path}/{s.name}"
        parts = [_digest(tables[n]).withColumnRenamed("h", f"h{k}") for k, n in enumerate(s.after)]
        docs = parts[0]
        for p in parts[1:]:
            docs = docs.join(p, "doc_id", "full")
        docs = docs.withColumn(KEY, key_of([f"h{k}" for k in range(len(parts))], f"{s.name} {s.version}", s.settings)).select("doc_id", KEY)
        known = _parts(spark, f"{place}/keys", f"doc_id bigint, {KEY} string, run string").groupBy("doc_id", KEY).agg(F.max("run").alias("run"))
        may = only is None or s.name in only
        todo = docs if s.name in force and may else docs.join(known, ["doc_id", KEY], "left_anti")
        run_name = f"{len(files.names(spark, f'{place}/keys')):09d}-{uuid.uuid4().hex[:8]}"
        computed = 0
        if may:
            # the keys are written last: until then the results count for nothing
            todo.write.parquet(f"{place}/todo/{run_name}")
            todo = spark.read.schema(f"doc_id bigint, {KEY} string").parquet(f"{place}/todo/{run_name}")
            computed = todo.count()
            if computed:
                inputs = [tables[n].join(todo.select("doc_id"), "doc_id", "left_semi") for n in s.after]
                out = s.compute(*inputs).join(todo, "doc_id").withColumn("run", F.lit(run_name))
                out.write.parquet(f"{place}/results/{run_name}")
                todo.withColumn("run", F.lit(run_name)).write.parquet(f"{place}/keys/{run_name}")
        kept = _parts(spark, f"{place}/keys", f"doc_id bigint, {KEY} string, run string").groupBy("doc_id", KEY).agg(F.max("run").alias("run"))
        current = docs.join(kept, ["doc_id", KEY])
        results = _parts(spark, f"{place}/results", f"{s.schema}, {KEY} string, run string")
        tables[s.name] = results.join(current, ["doc_id", KEY, "run"], "left_semi").drop(KEY, "run")
        total = docs.count()
        report[s.name] = {"computed": computed, "reused": total - computed if may else current.count()}
    return {s.name: tables[s.name] for s in stages}, report
