"""Rewrite rules: validation, ordered union and application."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 500


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct (pattern, replacement) with the first position; the second set comes after the first."""
    both = first.select("pattern", "replacement", "pos").unionByName(second.select("pattern", "replacement", (F.col("pos") + 1000).alias("pos")))
    return both.groupBy("pattern", "replacement").agg(F.min("pos").alias("pos"))


def validate(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Drops blank and uncompilable patterns, keeps the last of each pattern, sorts; more than MOST_RULES is an error."""
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kept: dict[str, str] = {}
    for pattern, replacement in rules:
        try:
            re.compile(pattern)
        except re.error:
            continue
        if pattern.strip():
            kept[pattern] = replacement
    return sorted(kept.items())


def java_replacement(text: str) -> str:
    """Python's group references as Java's."""
    text = text.replace("$", r"\$")
    return re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: f"${{{m[1]}}}" if m[1] and not m[1].isdigit() else f"${m[1] or m[2]}", text)


def apply(text: Column, rules: Iterable[tuple[str, str]], ignore_case: bool = True) -> Column:
    """Every rule in turn, as nested built-in replacements; rules that don't compile are skipped."""
    for pattern, replacement in rules:
        try:
            re.compile(pattern)
        except re.error:
            continue
        text = F.regexp_replace(text, ("(?iuU)" if ignore_case else "(?U)") + pattern, java_replacement(replacement))
    return text
