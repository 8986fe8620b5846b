"""What a rewrite rule would do to a text: its hits, the new text and a unified diff, each within a limit, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import types as T

from vocalis.functions.text_udf import by_slices

#: Lines of context around a change, and pairs of lines that a comparison may look at.
CONTEXT, BUDGET = 2, 4_000_000
HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _changes(a: list[str], b: list[str], budget: int) -> list[tuple[str, int, int, int, int]]:
    """(kind, from, to, from, to) runs as SequenceMatcher has them; beyond the budget what the ends don't share is one change."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    counts: dict[str, int] = {}
    for line in y:
        counts[line] = counts.get(line, 0) + 1
    if sum(counts.get(line, 0) for line in x) <= budget:
        return SequenceMatcher(None, a, b).get_opcodes()
    ends = [("equal", 0, head, 0, head), ("replace", head, len(a) - tail, head, len(b) - tail), ("equal", len(a) - tail, len(a), len(b) - tail, len(b))]
    return [e for e in ends if e[1] < e[2] or e[3] < e[4]]


def _hunks(changes: list[tuple[str, int, int, int, int]], context: int) -> Iterator[list[tuple[str, int, int, int, int]]]:
    hunk: list[tuple[str, int, int, int, int]] = []
    for kind, i, j, k, m in changes:
        if kind != "equal":
            hunk.append((kind, i, j, k, m))
        elif hunk and j - i > 2 * context:
            yield [*hunk, (kind, i, i + context, k, k + context)] if context else hunk
            hunk = [(kind, j - context, j, m - context, m)]
        elif hunk:
            hunk.append((kind, i, j, k, m))
        else:
            hunk = [(kind, max(i, j - context), j, max(k, m - context), m)]
    if any(h[0] != "equal" for h in hunk):
        if hunk[-1][0] == "equal":
            kind, i, j, k, m = hunk[-1]
            hunk[-1] = (kind, i, min(j, i + context), k, min(m, k + context))
        yield hunk


def _range(start: int, end: int) -> str:
    n = end - start
    return str(start + 1) if n == 1 else f"{start + (n > 0)},{n}"


def unified(before: str, after: str, names: tuple[str, str] = ("source", "preview"), context: int = CONTEXT, budget: int = BUDGET) -> str:
    """A unified diff by lines, empty where the texts are equal. A text's lines are what line feeds separate, the last one too."""
    if before == after:
        return ""
    a, b = before.split("\n"), after.split("\n")
    out = [f"--- {names[0]}", f"+++ {names[1]}"]
    for hunk in _hunks(_changes(a, b, budget), context):
        out.append(f"@@ -{_range(hunk[0][1], hunk[-1][2])} +{_range(hunk[0][3], hunk[-1][4])} @@")
        for kind, i, j, k, m in hunk:
            out += [f" {x}" for x in a[i:j]] if kind == "equal" else [f"-{x}" for x in a[i:j]] + [f"+{x}" for x in b[k:m]]
    return "\n".join(out)


def patched(text: str, diff: str) -> str:
    """The text that a unified diff of it leads to; a diff of another text raises."""
    if not diff:
        return text
    lines, out, at = text.split("\n"), [], 0
    for line in diff.split("\n")[2:]:
        if m := HUNK.match(line):
            start = int(m[1]) - (m[2] != "0")
            out += lines[at:start]
            at = start
        elif line[0] == "+":
            out.append(line[1:])
        else:
            if at >= len(lines) or lines[at] != line[1:]:
                raise ValueError(f"line {at + 1} differs")
            if line[0] == " ":
                out.append(line[1:])
            at += 1
    return "\n".join(out + lines[at:])


diff = by_slices(lambda x, y: None if x is None or y is None else unified(x, y), T.StringType(), pa.string())
patch = by_slices(lambda x, d: None if x is None or d is None else patched(x, d), T.StringType(), pa.string())


RESULT = T.StructType([T.StructField("hits", T.LongType()), T.StructField("text", T.StringType()), T.StructField("diff", T.StringType()), T.StructField("error", T.StringType())])
KIND = pa.struct([("hits", pa.int64()), ("text", pa.string()), ("diff", pa.string()), ("error", pa.string())])


def rewritten(text: str, pattern: str, replacement: str, ignore_case: bool, seconds: float) -> tuple[int | None, str | None, str | None, str | None]:
    try:
        new, hits = regex.subn(pattern, replacement, text, flags=regex.IGNORECASE if ignore_case else 0, timeout=seconds)
    except TimeoutError:
        return None, None, None, f"more than {round(seconds * 1000)} ms"
    except (regex.error, IndexError) as e:
        return None, None, None, f"no pattern: {e}"
    return hits, new, unified(text, new), None


def preview(text: Column, pattern: str, replacement: str, ignore_case: bool = True, limit_ms: int = 500) -> Column:
    """A struct (hits, text, diff, error) of a rule on each text; one that takes longer than the limit, or doesn't compile, has an error."""

    def run(t: str | None) -> dict:
        found = (None, None, None, None) if t is None else rewritten(t, pattern, replacement, ignore_case, limit_ms / 1000)
        return dict(zip(RESULT.names, found, strict=True))

    return by_slices(run, RESULT, KIND)(text)
