"""Mixing sources to target weights by weighted fair queueing; DataFrame operations only.

Every document, in an order shuffled by a hash of its id, gets a virtual finish time: the words of its source so far,
divided by the source's target. A source below its target is read up to ``max_repeats`` times. All copies are range-sorted by
their finish time and cut at the total budget, so that the documents of each source come in its target's proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalis.llm.frames import narrow, saved, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rows that a slice of a source's shuffled order, or a range of finish times, holds at most on average.
ROWS_PER_RANGE = 1 << 18


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """From (source, source_size): each source's rank and target, and the budget.

    Targets share the sum of all sizes by weight; none is above max_repeats times its source's size, and what that leaves over
    goes to the others by weight. Sources are ranked by code point, null last, and the weights repeat along that rank. Sorted by
    size over weight the capped sources come first, so the level at which the others fill up needs two running sums.
    """
    ranked = sizes.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source_rank").asc())
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("budget", F.sum("source_size").over(W.partitionBy())).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    fill = F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy())
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(fill * F.col("weight"))).select("source", "source_rank", "source_size", "target", "budget")


def schedule(placed: DataFrame, max_repeats: int) -> DataFrame:
    """The mix in order: (row, copy, finish, running) of every copy that the budget takes.

    Copies are range-sorted by their finish time over the whole table; each range sums its words, the ranges' sums give each one's
    offset, and a copy stays if the words up to it are within the budget. The number of ranges grows with the rows.
    """
    copies = placed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    copies = copies.withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target"))
    place = ("finish", "source_rank", "copy", "key", "doc_id", "size", "row")
    rows = placed.count()
    ranges = max(shuffle_partitions(placed.sparkSession), -(-rows * max_repeats // ROWS_PER_RANGE))
    ordered = copies.repartitionByRange(ranges, *place).select(*place, "budget", F.spark_partition_id().alias("range"))
    ordered = saved(ordered)
    offsets = ordered.groupBy("range").agg(F.sum("size").alias("words")).select("range", (F.sum("words").over(W.orderBy("range")) - F.col("words")).alias("offset"))
    inside = F.sum("size").over(W.partitionBy("range").orderBy(*place).rowsBetween(W.unboundedPreceding, 0))
    running = ordered.withColumn("inside", inside).join(offsets, "range").withColumn("running", F.col("offset") + F.col("inside"))
    return running.where(F.col("running") <= F.col("budget")).select("row", "copy", "finish", "running")


def place(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Each document with its source's target and ``upto``, the words of its source up to it in shuffled order.

    ``row`` numbers the rows; the second table has the columns named in ``carry`` as the struct ``document`` by row.
    """
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    columns = ["doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")]
    base = narrow(docs, *dict.fromkeys(("doc_id", "text", "source", *carry))).select(*columns, *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("document")] if carry else []))
    base = saved(base)
    bits = max(8, (base.count() // ROWS_PER_RANGE).bit_length())  # the keys are uniform: so many leading bits make even slices
    base = base.withColumn("slice", F.shiftright("key", max(0, 32 - bits)))
    by_slice = base.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    by_source = targets(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_repeats)
    before = F.coalesce(F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = by_slice.withColumn("before", before).alias("a").join(by_source.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.slice", "before", "source_rank", "source_size", "target", "budget")
    inside = W.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(W.unboundedPreceding, 0)
    numbered = base.select("doc_id", "source", "size", "key", "row", "slice").withColumn("inside", F.sum("size").over(inside))
    placed = numbered.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice")))
    placed = saved(placed.select("doc_id", "d.source", "size", "source_size", "target", "budget", "source_rank", "key", "row", (F.col("before") + F.col("inside")).alias("upto")))
    return placed, base.select("row", *(["document"] if carry else []))


RESULT = ("size", "source_size", "target", "taken", "copies", "first_finish")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, first_finish.

    ``taken`` counts the words that the mix takes of the document, repeats counted; it is 0, size, 2 * size and so on, at most
    max_repeats * size. A null text has size 0, a null source is a source of its own, documents without words are taken 0 times
    and an empty table gives an empty result. Rows with equal ids are ordered by size; equal rows are interchangeable.
    """
    return _taken(place(docs, weights, max_repeats)[0], max_repeats).select("doc_id", "source", *RESULT)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """The documents with all their columns, and mix()'s size, source_size, target, taken, copies and first_finish.

    ``copies`` tells how often the mix holds a document, 0 where it doesn't; sorted by first_finish the first copies come in the
    order of the mix. Where documents have a column of such a name, the mix's own is called mix_<name>.
    """
    placed, whole = place(docs, weights, max_repeats, tuple(docs.columns))
    out = _taken(placed, max_repeats).join(whole, "row")
    taken_names = set(docs.columns)
    own = []
    for name in RESULT:
        called = name
        while called in taken_names:
            called = f"mix_{called}"
        taken_names.add(called)
        own.append(F.col(name).alias(called))
    return out.select(*[F.col(f"document.`{c}`").alias(c) for c in docs.columns], *own)


def _taken(placed: DataFrame, max_repeats: int) -> DataFrame:
    times = schedule(placed, max_repeats).groupBy("row").agg(F.count("*").alias("times"))
    n = F.coalesce("times", F.lit(0))
    first = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("upto") / F.col("target"))
    return placed.join(times, "row", "left").withColumns({"taken": (F.col("size") * n).cast("long"), "copies": n.cast("int"), "first_finish": first})
