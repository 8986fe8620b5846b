"""Predicates and lookups of the job and document registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The failure classes and the log texts that name them, first match wins.
FAILURES = (("oom", "out of memory"), ("disk_full", "no space"), ("permission", "permission denied"), ("missing_input", "not found"))
ACTIONS = {"missing": "", "transcribed": "clean", "cleaned": "scan,apply", "validated": "export", "exported": "export,check,query"}


def document_state() -> Column:
    """From the booleans work, clean, rules and export: the first step that a document lacks."""
    return F.when(~F.col("work"), "missing").when(~F.col("clean"), "transcribed").when(~F.col("rules"), "cleaned").when(~F.col("export"), "validated").otherwise("exported")


def allowed_actions() -> Column:
    """What may run next, joined by commas; nothing while the document is locked."""
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.when(F.col("locked"), "").otherwise(F.element_at(table, document_state()))


def failure_class(log: Column, cancelled: Column) -> Column:
    out = F.when(cancelled, "cancelled")
    for name, needle in FAILURES:
        out = out.when(F.lower(log).contains(needle), name)
    return out.otherwise("unknown")


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The longest keyword that the text holds; of equally long ones the first by name."""
    out = F.lit(None).cast("string")
    for k in sorted(keywords, key=lambda k: (-len(k), k))[::-1]:
        out = F.when(text.contains(k), k).otherwise(out)
    return out


def search(jobs: DataFrame, doc: str = "", action: str = "") -> DataFrame:
    return jobs.where(F.lower(F.col("doc").cast("string")).contains(doc.lower()) & F.lower("action").contains(action.lower()))


def latest(jobs: DataFrame, key: str = "doc", order: str = "id") -> DataFrame:
    """The newest row of each key, from an append-only log."""
    rest = [c for c in jobs.columns if c not in (key, order)]
    return jobs.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])
