"""Ordered folds with a state that resets: they aren't window functions, so each document's rows become one sorted array and a
higher-order aggregate walks it inside the JVM. A document is one task's work; its array holds ordinals and numbers, not text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = "array<struct<a:int,b:int>>"


def _rows(df: DataFrame, *columns: str, order: str = "idx") -> DataFrame:
    return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def budget_chunks(df: DataFrame, target: int, overlap: int, size: str = "words", least: int = 40) -> DataFrame:
    """(doc_id, chunk, a, b): rows a..b (from 1) of each chunk, closed when the sum of sizes reaches max(least, target). The shortest
    suffix that reaches the overlap is carried into the next chunk. What is left at the end is a chunk, carried rows alone too."""
    limit = max(least, target)
    at = lambda i: F.element_at(F.col("rows"), i)[size]
    carry_state = F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("long").alias("sum"))

    def carried(first: Column, last: Column) -> Column:
        """How many of the rows first..last, from the end, are carried."""
        if overlap <= 0:
            return F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("long").alias("sum"))
        step = lambda s, k: F.when(s["sum"] >= overlap, s).otherwise(F.struct((s["n"] + 1).cast("int").alias("n"), (s["sum"] + at(last - k)).cast("long").alias("sum")))
        return F.aggregate(F.sequence(F.lit(0), last - first), carry_state, step)

    start = F.struct(F.lit(1).cast("int").alias("first"), F.lit(0).cast("long").alias("sum"), F.expr(f"cast(array() as {RANGE})").alias("out"))

    def walk(s: Column, i: Column) -> Column:
        total = (s["sum"] + at(i)).cast("long")
        c = carried(s["first"], i)
        closed = F.struct((i + 1 - c["n"]).cast("int").alias("first"), c["sum"].cast("long").alias("sum"), F.concat(s["out"], F.array(F.struct(s["first"].cast("int").alias("a"), i.cast("int").alias("b")))).cast(RANGE).alias("out"))
        return F.when(total >= limit, closed).otherwise(F.struct(s["first"], total.alias("sum"), s["out"]))

    def finish(s: Column) -> Column:
        n = F.size(F.col("rows"))
        return F.when(s["first"] <= n, F.concat(s["out"], F.array(F.struct(s["first"].alias("a"), n.cast("int").alias("b"))).cast(RANGE))).otherwise(s["out"])

    folded = _rows(df, size).select("doc_id", F.aggregate(F.sequence(F.lit(1), F.size("rows")), start, walk, finish).alias("ranges"))
    return folded.select("doc_id", F.posexplode("ranges").alias("chunk", "r")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("r.a").cast("long").alias("a"), F.col("r.b").cast("long").alias("b"))


def counted_chunks(df: DataFrame, target: int, least_tokens: int, least_rows: int, overlap_rows: int, size: str = "tokens") -> DataFrame:
    """As budget_chunks, closed when a chunk has enough rows and tokens and reaches the target; the last rows are carried."""
    at = lambda i: F.element_at(F.col("rows"), i)[size]
    start = F.struct(F.lit(1).cast("int").alias("first"), F.lit(0).cast("long").alias("sum"), F.expr(f"cast(array() as {RANGE})").alias("out"))

    def walk(s: Column, i: Column) -> Column:
        total = (s["sum"] + at(i)).cast("long")
        kept = F.aggregate(F.sequence(F.lit(0), F.lit(overlap_rows - 1)), F.lit(0).cast("long"), lambda x, k: (x + at(i - k)).cast("long")) if overlap_rows else F.lit(0).cast("long")
        closed = F.struct((i + 1 - overlap_rows).cast("int").alias("first"), kept.alias("sum"), F.concat(s["out"], F.array(F.struct(s["first"].cast("int").alias("a"), i.cast("int").alias("b")))).cast(RANGE).alias("out"))
        close = (i - s["first"] + 1 >= max(least_rows, overlap_rows + 1)) & (total >= max(least_tokens, target))
        return F.when(close, closed).otherwise(F.struct(s["first"], total.alias("sum"), s["out"]))

    def finish(s: Column) -> Column:
        n = F.size(F.col("rows"))
        return F.when(s["first"] <= n, F.concat(s["out"], F.array(F.struct(s["first"].alias("a"), n.cast("int").alias("b"))).cast(RANGE))).otherwise(s["out"])

    folded = _rows(df, size).select("doc_id", F.aggregate(F.sequence(F.lit(1), F.size("rows")), start, walk, finish).alias("ranges"))
    return folded.select("doc_id", F.posexplode("ranges").alias("chunk", "r")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("r.a").cast("long").alias("a"), F.col("r.b").cast("long").alias("b"))


def grouped(df: DataFrame, columns: tuple[str, ...], state: Column, step, name: str = "group", whole: tuple[str, ...] = ()) -> DataFrame:
    """Numbers rows by a fold: ``step(state, row)`` returns the new state, whose field ``g`` is the row's group. Returns doc_id, idx, group.

    With ``whole`` columns it returns doc_id, group and ``rows``, each group's rows in order with these columns, too: a frame that is dear
    to compute is then read once and needs no join.

    The walk appends a row's number only where a group begins, in blocks that are closed when they are full, so that appending
    copies a block and not all that came before; the groups of the rows follow from their beginnings.
    """
    block = 512
    numbers = "cast(array() as array<struct<i:int,g:bigint>>)"
    seeded = F.struct(state.alias("s"), F.lit(0).alias("i"), F.lit(None).cast("long").alias("g"), F.expr(numbers).alias("now"), F.expr("cast(array() as array<array<struct<i:int,g:bigint>>>)").alias("full"))

    def walk(acc: Column, row: Column) -> Column:
        new = step(acc["s"], row)
        g = new["g"].cast("long")
        fresh = acc["g"].isNull() | (acc["g"] != g)
        full = F.size(acc["now"]) >= block
        kept = F.when(fresh & full, F.expr(numbers)).otherwise(acc["now"])
        begun = F.array(F.struct(acc["i"].alias("i"), g.alias("g")))
        return F.struct(new.alias("s"), (acc["i"] + 1).alias("i"), g.alias("g"), F.when(fresh, F.concat(kept, begun)).otherwise(kept).alias("now"), F.when(fresh & full, F.concat(acc["full"], F.array(acc["now"]))).otherwise(acc["full"]).alias("full"))

    begins = F.aggregate("rows", seeded, walk, lambda acc: F.concat(F.flatten(acc["full"]), acc["now"]))
    if whole:
        kept = _rows(df, *columns, *whole).select("doc_id", "rows", begins.alias("begins"))
        after = lambda k: F.coalesce(F.try_element_at(F.col("begins"), (k + 2).cast("int"))["i"], F.size("rows"))
        parts = F.transform("begins", lambda b, k: F.struct(b["g"].alias("g"), F.slice("rows", b["i"] + 1, after(k) - b["i"]).alias("rows")))
        return kept.select("doc_id", F.explode(parts).alias("z")).select("doc_id", F.col("z.g").alias(name), F.col("z.rows").alias("rows"))
    folded = _rows(df, *columns).select("doc_id", F.transform("rows", lambda r: r["idx"]).alias("ids"), begins.alias("begins"))

    def members(b: Column, k: Column) -> Column:
        upto = F.coalesce(F.try_element_at(F.col("begins"), (k + 2).cast("int"))["i"], F.size("ids"))
        return F.transform(F.slice("ids", b["i"] + 1, upto - b["i"]), lambda x: F.struct(x.alias("idx"), b["g"].alias("g")))

    return folded.select("doc_id", F.explode(F.flatten(F.transform("begins", members))).alias("z")).select("doc_id", F.col("z.idx").alias("idx"), F.col("z.g").alias(name))


def sections(df: DataFrame, target_ms: int = 180_000, most_ms: int = 480_000, pause_ms: int = 6_000, soft_ms: int = 150_000) -> DataFrame:
    """A section closes before a row if it would exceed the most; after the target at a pause; or after the soft minimum at a pause."""
    state = F.struct(F.lit(0).cast("long").alias("g"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("upto"))

    def step(s: Column, r: Column) -> Column:
        length, gap = s["upto"] - s["from"], r["t0"] - s["upto"]
        close = s["from"].isNotNull() & ((r["t1"] - s["from"] > most_ms) | (length >= target_ms) & (gap >= 0) | (length >= soft_ms) & (gap >= pause_ms))
        close = F.coalesce(close, F.lit(False))
        return F.struct((s["g"] + close.cast("long")).cast("long").alias("g"), F.when(close | s["from"].isNull(), r["t0"]).otherwise(s["from"]).alias("from"), r["t1"].alias("upto"))

    return grouped(df, ("t0", "t1"), state, step, "section")


def paragraphs(df: DataFrame, most_rows: int = 4, most_chars: int = 400, whole: tuple[str, ...] = ()) -> DataFrame:
    """A paragraph ends at a new speaker, at most_rows rows, or before its text would exceed most_chars."""
    state = F.struct(F.lit(0).cast("long").alias("g"), F.lit(None).cast("string").alias("who"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"))

    def step(s: Column, r: Column) -> Column:
        close = F.coalesce((s["n"] > 0) & ((s["who"] != r["speaker"]) | (s["n"] >= most_rows) | (s["chars"] + r["chars"] > most_chars)), F.lit(False))
        return F.struct((s["g"] + close.cast("long")).cast("long").alias("g"), r["speaker"].alias("who"), F.when(close, 1).otherwise(s["n"] + 1).cast("long").alias("n"), F.when(close, r["chars"]).otherwise(s["chars"] + r["chars"]).cast("long").alias("chars"))

    return grouped(df, ("speaker", "chars"), state, step, "paragraph", whole)


def stable_turns(df: DataFrame, least_ms: int = 1_200) -> DataFrame:
    """Merges a row into the current turn if the speaker stays or the row is shorter than the least turn. Returns doc_id, idx, turn."""
    state = F.struct(F.lit(0).cast("long").alias("g"), F.lit(None).cast("string").alias("who"))

    def step(s: Column, r: Column) -> Column:
        stay = F.coalesce(s["who"].isNotNull() & ((s["who"] == r["speaker"]) | (r["t1"] - r["t0"] < least_ms)), F.lit(False))
        return F.struct((s["g"] + (~stay).cast("long")).cast("long").alias("g"), F.when(stay, s["who"]).otherwise(r["speaker"]).alias("who"))

    return grouped(df, ("speaker", "t0", "t1"), state, step, "turn")


def short_merge(df: DataFrame, least_ms: int = 1_500, gap_ms: int = 200) -> DataFrame:
    """Merges a row that is short into the one before if the gap is small, whatever the speaker. Returns doc_id, idx, group."""
    state = F.struct(F.lit(0).cast("long").alias("g"), F.lit(None).cast("long").alias("upto"))

    def step(s: Column, r: Column) -> Column:
        stay = F.coalesce((r["t1"] - r["t0"] < least_ms) & (r["t0"] - s["upto"] <= gap_ms), F.lit(False))
        return F.struct((s["g"] + (~stay).cast("long")).cast("long").alias("g"), r["t1"].alias("upto"))

    return grouped(df, ("t0", "t1"), state, step)
