"""Operators on the ordered rows of a document: labels, samples, interpolation, and the folds that need state in Python."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from vocalis.functions import text, text_udf


def chunk_rows(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk rows (start, end, text, ids, mean confidence) from ranges of row numbers; a row can be in several chunks."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))
    member = chunks.select("doc_id", "chunk", F.explode(F.sequence("a", "b")).alias("i"))
    joined = rows.withColumn("i", n.cast("long")).join(member, ["doc_id", "i"])
    ordered = F.array_sort(F.collect_list(F.struct("i", "idx", "text")))
    return joined.groupBy("doc_id", "chunk").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.array_join(F.transform(ordered, lambda x: x["idx"].cast("string")), ",").alias("segment_ids"), (F.sum("conf") / (F.count("*") * 100)).alias("confidence"))


def limit_speakers(df: DataFrame, most: int) -> DataFrame:
    """Labels speakers in the order in which they come; those beyond ``most`` get the last label."""
    first = df.groupBy("doc_id", "speaker").agg(F.min("idx").alias("f"))
    rank = F.least(F.row_number().over(W.partitionBy("doc_id").orderBy("f")), F.lit(most)) - 1
    label = F.concat(F.lit("SPEAKER_"), F.lpad(rank.cast("string"), 2, "0"))
    return df.join(first.select("doc_id", "speaker", label.alias("label")), ["doc_id", "speaker"]).select("doc_id", "idx", "label")


def interpolate(segments: DataFrame) -> DataFrame:
    """(doc_id, idx, k, s0, s1): each sentence's share of its segment's time, by characters; the last one ends with the segment."""
    q = segments.select("doc_id", "idx", "t0", "t1", F.posexplode(text.split_sentences(F.col("text"))).alias("k", "s")).withColumn("n", F.length("s").cast("long"))
    w = W.partitionBy("doc_id", "idx")
    q = q.withColumn("upto", F.sum("n").over(w.orderBy("k"))).withColumn("total", F.sum("n").over(w)).where("total > 0")
    at = lambda c: F.expr(f"t0 + ((t1 - t0) * ({c})) div total")
    return q.select("doc_id", "idx", F.col("k").cast("long").alias("k"), at("upto - n").alias("s0"), at("upto").alias("s1"))


def systematic_sample(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Every max(1, n div most)-th row of each key, at most ``most``."""
    w = W.partitionBy(key)
    at, step = F.row_number().over(w.orderBy(order)) - 1, F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))
    marked = df.withColumn("__at", at).withColumn("__step", step)
    return marked.where("__at % __step = 0 AND __at < __step * " + str(most)).drop("__at", "__step")


def redundant(key: str, start: int, kept: Iterable[tuple[str, int]], ratio: float, window: int, gap_ms: int) -> bool:
    """Whether a text is near one of the last ``window`` kept ones, by ratio and by time."""
    return any(start - end <= gap_ms and text_udf.reaches(key, other, ratio) for other, end in list(kept)[-window:])


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _islands(df: DataFrame, gap_ms: int) -> DataFrame:
    """df with ``__island``: rows that start later than the gap after all earlier ones of the document have ended begin a new one."""
    order = W.partitionBy("doc_id").orderBy("idx")
    ended = F.max("t1").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("t0") - ended > gap_ms, F.lit(True)).cast("int")
    return df.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__fresh")


def _folded(df: DataFrame, gap_ms: int, fold: Callable[[], Callable[[dict], list[dict]]], last: Callable, schema: T.StructType) -> DataFrame:
    """Rows of each island through a fold of its own. ``fold()`` takes a row and returns rows that are done, ``last`` those left at the end.

    The window of the islands leaves a document's rows in one task and in order, so a task walks its rows and holds one slice of them.
    """
    kind = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, out = None, None, []
        for batch in batches:
            for k in range(0, batch.num_rows, text_udf.SLICE):
                for r in batch.slice(k, text_udf.SLICE).to_pylist():
                    if (r["doc_id"], r["__island"]) != key:
                        out += last(now) if now else []
                        now, key = fold(), (r["doc_id"], r["__island"])
                    out += now(r)
                if len(out) >= text_udf.SLICE:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
        out += last(now) if now else []
        yield pa.RecordBatch.from_pylist(out, kind)

    return _islands(df, gap_ms).sortWithinPartitions("doc_id", "idx").mapInArrow(work, schema)


class _Distinct:
    """Keeps the rows that don't repeat one of the last kept rows."""

    def __init__(self, ratio: float, window: int, gap_ms: int, least: int):
        self.rule, self.least, self.kept = (ratio, window, gap_ms), least, deque(maxlen=max(1, window))

    def new(self, key: str, t0: int, t1: int) -> bool:
        if len(key) >= self.least and redundant(key, t0, self.kept, *self.rule):
            return False
        self.kept.append((key, t1))
        return True


def drop_redundant(df: DataFrame, ratio: float = 0.9, window: int = 3, gap_ms: int = 5_000, least: int = 8) -> DataFrame:
    """(doc_id, idx): rows that don't repeat one of the last kept rows. Short rows always stay.

    A pause longer than the gap makes islands that don't touch one another.
    """

    def fold() -> Callable[[dict], list[dict]]:
        seen = _Distinct(ratio, window, gap_ms, least)
        return lambda r: [{"doc_id": r["doc_id"], "idx": r["idx"]}] if seen.new(" ".join(r["text"].lower().split()), r["t0"], r["t1"]) else []

    rows = df.select("doc_id", "idx", "text", "t0", "t1")
    return _folded(rows, gap_ms, fold, lambda now: [], _schema("doc_id bigint, idx bigint"))


class _Cleaner:
    """Sanitizes rows, drops those that are blank or repeat, and joins short ones to the row before."""

    def __init__(self, least_ms: int, gap_ms: int):
        self.least_ms, self.gap_ms, self.seen, self.open = least_ms, gap_ms, _Distinct(0.9, 3, 5_000, 8), None

    def __call__(self, r: dict) -> list[dict]:
        words, now = text_udf.sanitize_text(r["text"]), self.open
        if not words or not self.seen.new(words.lower(), r["t0"], r["t1"]):
            return []
        if now and r["t1"] - r["t0"] < self.least_ms and r["t0"] - now["t1"] <= self.gap_ms:
            now["t1"], now["merged"] = r["t1"], now["merged"] + 1
            now["text"].append(words)
            return []
        self.open = {c: r[c] for c in ("doc_id", "idx", "speaker", "t0", "t1")} | {"text": [words], "merged": 0}
        return self.done(now)

    @staticmethod
    def done(row: dict | None) -> list[dict]:
        return [row | {"text": " ".join(row["text"])}] if row else []


def clean(df: DataFrame, least_ms: int = 1_500, gap_ms: int = 200) -> DataFrame:
    """Sanitizes, drops blank and redundant rows, then joins a short row to the one before: (doc_id, idx, speaker, t0, t1, text, merged).

    Rows apart by more than the five seconds in which repeats count are islands of their own.
    """
    schema = _schema("doc_id bigint, idx bigint, speaker string, t0 bigint, t1 bigint, text string, merged bigint")
    return _folded(df, max(5_000, gap_ms), lambda: _Cleaner(least_ms, gap_ms), lambda now: now.done(now.open), schema)


def merge_overlaps(df: DataFrame, similar: float = 0.15, gap_ms: int = 200) -> DataFrame:
    """Joins windows whose ends overlap: (doc_id, idx, t0, t1, text).

    The words that two windows share at the seam are kept once if they are near enough by edit distance; else the window of
    higher mean log-probability keeps its words and the other is trimmed in time. Gaps up to gap_ms are closed.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values("idx").itertuples():
            words, t0 = r.text.split(), r.t0
            if out and t0 < out[-1]["t1"]:
                last = out[-1]["words"]
                n = next((k for k in range(min(6, len(last), len(words)), 0, -1) if 1 - text_udf.gestalt_ratio(" ".join(last[-k:]), " ".join(words[:k])) <= similar), 0)
                words = words[n:]
                if r.logprob > out[-1]["logprob"] and not n:
                    out[-1]["t1"] = t0
                else:
                    t0 = out[-1]["t1"]
            elif out and 0 < t0 - out[-1]["t1"] <= gap_ms:
                out[-1]["t1"] = t0
            out.append({"idx": r.idx, "t0": t0, "t1": max(t0, r.t1), "words": words, "logprob": r.logprob})
        return pd.DataFrame({"doc_id": pdf.doc_id.iloc[0], "idx": [o["idx"] for o in out], "t0": [o["t0"] for o in out], "t1": [o["t1"] for o in out], "text": [" ".join(o["words"]) for o in out]})

    return df.groupBy("doc_id").applyInPandas(run, "doc_id bigint, idx bigint, t0 bigint, t1 bigint, text string")


def assign_words(df: DataFrame) -> DataFrame:
    """(doc_id, idx, sentence, n_words): a segment's words dealt to its sentences by their share of words, at least one each while they last."""
    sizes = F.transform("sentences", lambda s: F.size(F.split(F.trim(s), r"\s+")))
    state = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("out"))
    n, all_words, count = F.size("ws"), F.aggregate(F.col("sizes"), F.lit(0), lambda a, x: a + x), F.size("sizes")

    def step(s, x):
        place = F.size(s["out"]) + 1
        upto = F.floor((s["seen"] + x) * n / all_words)
        least, most = s["used"] + 1, n - (count - place)
        end = F.when(place == count, n).otherwise(F.least(F.greatest(upto, least), F.greatest(most, s["used"]))).cast("int")
        return F.struct((s["seen"] + x).alias("seen"), end.alias("used"), F.concat(s["out"], F.array((end - s["used"]).cast("int"))).alias("out"))

    dealt = df.withColumn("sizes", sizes).select("doc_id", "idx", F.aggregate("sizes", state, step, lambda s: s["out"]).alias("dealt"))
    return dealt.select("doc_id", "idx", F.posexplode("dealt").alias("sentence", "n_words"))
