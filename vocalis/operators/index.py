"""An inverted index as tables, boolean and phrase matches, and BM25.

postings(term, chunk_id, tf, positions) is the large table: write it bucketed by term, and a search reads the buckets of its
terms only. lengths(chunk_id, n) and the corpus row (documents, mean length) are derived from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.functions.text_udf import SLICE

# Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def terms(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with term and positions (from 0, in order) for their ``words``: a row for each different word of a row.

    A row's words are put together where they are, in slices of an Arrow batch as numbers: an aggregate over all words sorts them twice.
    """
    kept = [c for c in rows.columns if c != "words"]
    rows = rows.select(*kept, "words")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                words = part.column(len(kept))
                row, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words).dictionary_encode()
                if not len(flat):
                    continue
                first = np.searchsorted(row, row)  # where a word's row begins
                order = np.argsort(row * len(flat.dictionary) + flat.indices.to_numpy(), kind="stable")
                row, code, at = row[order], flat.indices.to_numpy()[order], (np.arange(len(row)) - first)[order]
                begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
                positions = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(row)], pa.int32()), pa.array(at, pa.int32()))
                term = flat.dictionary.take(pa.array(code[begin]))
                yield pa.RecordBatch.from_arrays([*part.select(kept).take(pa.array(row[begin])).columns, term, positions], [*kept, "term", "positions"])

    return rows.mapInArrow(work, schema)


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    corpus: DataFrame


def build(chunks: DataFrame) -> Index:
    """From (chunk_id, text)."""
    placed = chunks.select("chunk_id", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    postings = placed.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    lengths = postings.groupBy("chunk_id").agg(F.sum("tf").alias("n"))
    return Index(postings, lengths, lengths.agg(F.count("*").alias("documents"), F.sum("n").alias("total")))


def match_all(index: Index, words: list[str]) -> DataFrame:
    hits = index.postings.where(F.col("term").isin(*words))
    return hits.groupBy("chunk_id").agg(F.count_distinct("term").alias("k")).where(F.col("k") == len(set(words))).select("chunk_id")


def match_any(index: Index, words: list[str]) -> DataFrame:
    return index.postings.where(F.col("term").isin(*words)).select("chunk_id").distinct()


def match_not(index: Index, word: str, without: str) -> DataFrame:
    return match_any(index, [word]).join(match_any(index, [without]), "chunk_id", "left_anti")


def match_prefix(index: Index, prefix: str) -> DataFrame:
    return index.postings.where(F.col("term").startswith(prefix)).select("chunk_id").distinct()


def match_phrase(index: Index, words: list[str]) -> DataFrame:
    """Chunks in which the words follow one another: each word's positions, moved back by its place, have one in common."""
    moved = None
    for k, word in enumerate(words):
        p = index.postings.where(F.col("term") == word).select("chunk_id", F.expr(f"transform(positions, x -> x - {k})").alias("p"))
        moved = p if moved is None else moved.alias("a").join(p.alias("b"), "chunk_id").select("chunk_id", F.array_intersect("a.p", "b.p").alias("p")).where("size(p) > 0")
    return moved.select("chunk_id")


def bm25(index: Index, words: list[str], limit: int) -> DataFrame:
    """The best chunks that hold all words: (chunk_id, score), more negative is better; equal scores in the order of ids."""
    hits = index.postings.where(F.col("term").isin(*words)).select("term", "chunk_id", "tf")
    spread = hits.groupBy("term").agg(F.count("*").alias("df"))
    one = index.corpus  # a single row
    joined = hits.join(match_all(index, words), "chunk_id").join(F.broadcast(spread), "term").join(index.lengths, "chunk_id").crossJoin(F.broadcast(one))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = K1 * (1 - B + B * F.col("n") / (F.col("total") / F.col("documents")))
    score = -idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return joined.groupBy("chunk_id").agg(F.round(F.sum(score), 6).alias("score")).orderBy("score", "chunk_id").limit(limit)
