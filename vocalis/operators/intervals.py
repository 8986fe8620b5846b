"""Interval joins inside a document: overlap, containment, midpoint, and semi joins with a fallback.

Catalyst has no range join. The document and a time bucket are equality keys, so that a task compares only neighbours. Buckets come
in several widths: a span stands in buckets at least as wide as itself, so that a long one isn't cut into many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Widths of time buckets. A span stands in buckets that are at least as wide as itself, so it touches two of them at most.
WIDTHS_MS = tuple(60_000 * 32**k for k in range(7))


def _widths(length: Column) -> Column:
    """The places of the bucket widths that are enough for a span of that length; the last one is for all that are longer."""
    need = F.lit(0)
    for k, width in enumerate(WIDTHS_MS[:-1]):
        need = F.when(length > width, k + 1).otherwise(need)
    return need


def _buckets(start: Column, end: Column, width: Column) -> Column:
    ms = F.element_at(F.array(*[F.lit(w) for w in WIDTHS_MS]), (width + 1).cast("int"))
    return F.sequence(F.floor(start / ms), F.floor(end / ms))


def _occurring(*lengths: DataFrame) -> list[int]:
    """The places of the widths that spans of these lengths (one column each) need: at most as many numbers as there are widths."""
    every = lengths[0]
    for more in lengths[1:]:
        every = every.unionByName(more)
    return sorted(r.w for r in every.select(_widths(F.col("length")).alias("w")).distinct().collect())


def overlap(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], tolerance_ms: int = 0, key: str = "doc_id") -> DataFrame:
    """Inner join of half-open spans that overlap.

    Two spans meet in buckets of the wider one's width: each side stands there if it is the wider or as wide, or else in the buckets
    that it touches of all wider widths that occur; which do, a small count over both sides tells first. A pair that shares two
    buckets comes once: in the one where the later span begins.
    """
    a0, a1 = (F.col(f"__a.{c}") for c in left_span)
    b0, b1 = (F.col(f"__b.{c}") for c in right_span)

    ends = (left, F.col(left_span[0]) - tolerance_ms, F.col(left_span[1]) + tolerance_ms), (right, F.col(right_span[0]), F.col(right_span[1]))
    occur = _occurring(*[df.select((F.greatest(start, end) - start).alias("length")) for df, start, end in ends])

    def placed(df: DataFrame, start: Column, end: Column) -> DataFrame:
        own = df.withColumn("__from", start).withColumn("__to", F.greatest(start, end)).withColumn("__own", _widths(F.col("__to") - F.col("__from")))
        wide = own.withColumn("__width", F.explode(F.filter(F.array(*[F.lit(w) for w in occur]).cast("array<int>"), lambda w: w >= F.col("__own"))))
        return wide.withColumn("__bucket", F.explode(_buckets(F.col("__from"), F.col("__to"), F.col("__width"))))

    a, b = placed(*ends[0]).alias("__a"), placed(*ends[1]).alias("__b")
    meets = (b1 > a0 - tolerance_ms) & (b0 < a1 + tolerance_ms)
    wider = F.col("__a.__width") == F.greatest("__a.__own", "__b.__own")
    ms = F.element_at(F.array(*[F.lit(w) for w in WIDTHS_MS]), (F.col("__a.__width") + 1).cast("int"))
    first = F.col("__a.__bucket") == F.floor(F.greatest("__a.__from", "__b.__from") / ms)
    same = (F.col(f"__a.{key}") == F.col(f"__b.{key}")) & (F.col("__a.__width") == F.col("__b.__width")) & (F.col("__a.__bucket") == F.col("__b.__bucket"))
    joined = a.join(b, same & meets & wider & first)
    shared = [c for c in right.columns if c != key]
    return joined.select(*[F.col(f"__a.{c}") for c in left.columns], *[F.col(f"__b.{c}") for c in shared])


def _holding(points: DataFrame, spans: DataFrame, closed: bool) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides by time bucket and the condition that a span (__doc, __s0, __s1) holds the point (doc_id, __point)."""
    occur = _occurring(spans.where("__s1 >= __s0").select((F.col("__s1") - F.col("__s0")).alias("length")))
    p = points.withColumn("__width", F.explode(F.array(*[F.lit(k) for k in occur]).cast("array<int>")))
    ms = F.element_at(F.array(*[F.lit(w) for w in WIDTHS_MS]), (F.col("__width") + 1).cast("int"))
    p = p.withColumn("__bucket", F.floor(F.col("__point") / ms))
    s = spans.withColumn("__w", _widths(F.col("__s1") - F.col("__s0")))
    s = s.where("__s1 >= __s0").withColumn("__b", F.explode(_buckets(F.col("__s0"), F.col("__s1"), F.col("__w"))))
    inside = (F.col("__point") >= F.col("__s0")) & (F.col("__point") <= F.col("__s1") if closed else F.col("__point") < F.col("__s1"))
    return p, s, (F.col("doc_id") == F.col("__doc")) & (F.col("__width") == F.col("__w")) & (F.col("__bucket") == F.col("__b")) & inside


def at_point(points: DataFrame, spans: DataFrame, point: Column, span: tuple[str, str], order: str, value: str, row_key: tuple[str, ...], closed: bool = True, fallback: bool = True) -> DataFrame:
    """Adds ``value`` of the first span (by ``order``) that holds the point; with fallback, of the document's last span otherwise."""
    named = spans.select(F.col("doc_id").alias("__doc"), F.col(span[0]).alias("__s0"), F.col(span[1]).alias("__s1"), F.col(order).alias("__order"), F.col(value).alias("__value"))
    p, s, inside = _holding(points.withColumn("__point", point), named, closed)
    hit = p.join(s, inside).groupBy(*row_key).agg(F.min_by("__value", "__order").alias(value))
    out = points.drop(value).join(hit, list(row_key), "left") if value in points.columns else points.join(hit, list(row_key), "left")
    if not fallback:
        return out
    last = spans.groupBy("doc_id").agg(F.max_by(value, order).alias("__last"))
    return out.join(last, "doc_id", "left").withColumn(value, F.coalesce(value, "__last")).drop("__last")


def near_speech(rows: DataFrame, speech: DataFrame, point: Column, margin_ms: int, row_key: tuple[str, ...]) -> DataFrame:
    """Rows whose point lies within a speech span, give or take the margin; a document in which none does keeps all its rows."""
    named = speech.select(F.col("doc_id").alias("__doc"), (F.col("s0") - margin_ms).alias("__s0"), (F.col("s1") + margin_ms).alias("__s1"))
    p, s, holds = _holding(rows.withColumn("__point", point), named, True)
    keys = p.join(s, holds, "left_semi").select(*row_key).distinct()
    inside = rows.join(keys, list(row_key), "left_semi")
    without = rows.join(keys.select("doc_id").distinct(), "doc_id", "left_anti")
    return inside.unionByName(without)
