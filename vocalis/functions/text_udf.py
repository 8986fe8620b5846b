"""Text functions that built-ins can't express: Arrow-batched, state inside one text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, deque
from itertools import islice

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.functions.text import FILLERS, MARKS, any_of

#: Rows of an Arrow batch that are Python values at a time.
SLICE = 256


def gestalt_matches(a: str, b: str) -> int:
    """Letters in SequenceMatcher's matching blocks, by searches for substrings.

    As there, letters that are more than a hundredth of a ``b`` of 200 letters or more begin no block; they only lengthen one.
    """
    popular = {c for c, k in Counter(b).items() if k > len(b) // 100 + 1} if len(b) >= 200 else set()
    if popular:
        one, two = (chr(k) for k in islice((k for k in range(0xE000, 0xF8FF) if chr(k) not in a and chr(k) not in b), 2))
        x, y = a.translate({ord(c): one for c in popular}), b.translate({ord(c): two for c in popular})
        rare = set(y) - {two}
    else:
        x, y, rare = a, b, set(b)
    starts = [i for i, c in enumerate(x) if c in rare]
    find, total, left = y.find, 0, [(0, len(a), 0, len(b))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        i, j, k = alo, blo, 0
        for s in islice(starts, bisect_left(starts, alo), bisect_left(starts, ahi)):
            if s + k >= ahi:
                break
            at = find(x[s : s + k + 1], blo, bhi)
            while at >= 0:
                i, j, k = s, at, k + 1
                at = find(x[s : s + k + 1], blo, bhi) if s + k < ahi else -1
        if popular:
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
        if k:
            total += k
            if alo < i and blo < j:
                left.append((alo, i, blo, j))
            if i + k < ahi and j + k < bhi:
                left.append((i + k, ahi, j + k, bhi))
    return total


def gestalt_ratio(a: str, b: str) -> float:
    """SequenceMatcher's ratio."""
    return 2.0 * gestalt_matches(a, b) / (len(a) + len(b)) if a or b else 1.0


def most_matched(a: str, b: str) -> int:
    """Letters of a longest common subsequence: no ratio matches more. A row of the table is one number's bits."""
    at: dict[str, int] = {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << k
    full = row = (1 << len(b)) - 1
    for c in a:
        if hit := row & at.get(c, 0):
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def reaches(a: str, b: str, least: float) -> bool:
    """Whether the ratio is ``least`` or more; counts of letters and a common subsequence come before it."""
    need = least * (len(a) + len(b)) / 2 - 1e-9
    if a == b or min(len(a), len(b)) < need:
        return a == b and least <= 1
    if (Counter(a) & Counter(b)).total() < need or most_matched(a, b) < need:
        return False
    return gestalt_ratio(a, b) >= least


def by_slices(f, returns: T.DataType, kind: pa.DataType):
    """A function of rows over columns, in slices of an Arrow batch: Python holds the values of a slice only, whatever the rows of a batch."""

    @F.arrow_udf(returns)
    def run(*columns: pa.Array) -> pa.Array:
        parts = []
        for k in range(0, len(columns[0]), SLICE):
            rows = zip(*[c.slice(k, SLICE).to_pylist() for c in columns], strict=True)
            parts.append(pa.array([f(*r) for r in rows], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def _ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else gestalt_ratio(a, b)


def _ratio_from(a: str | None, b: str | None, least: float) -> float | None:
    if a is None or b is None:
        return None
    need = least * (len(a) + len(b)) / 2 - 1e-9
    enough = min(len(a), len(b)) >= need and (Counter(a) & Counter(b)).total() >= need
    return gestalt_ratio(a, b) if enough and most_matched(a, b) >= need else None


gestalt = by_slices(_ratio, T.DoubleType(), pa.float64())
#: The ratio, or null where the letters or a common subsequence alone show that it is below the third column.
gestalt_from = by_slices(_ratio_from, T.DoubleType(), pa.float64())


def mark_text(text: str, words: list[dict], below: float = 0.35, style: str = "**[{word}?]**") -> str:
    """Marks the tokens whose word is of low probability.

    Each token takes the next word of the same letters from those that no token before has passed; so both lists are walked once,
    and a token that no later word matches uses the words up.
    """
    plain = lambda s: re.sub(r"[^\w]", "", s.lower())
    rest = iter(words)
    out = []
    for token in re.split(r"(\s+)", text):
        if key := plain(token):
            match = next((w for w in rest if plain(w["word"] or "") == key), None)
            if match is not None and match["probability"] is not None and match["probability"] < below:
                token = style.replace("{word}", token)
        out.append(token)
    return "".join(out)


def _marked(text: str | None, words: list[dict] | None) -> str | None:
    return None if text is None else mark_text(text, words or [])


mark_low = by_slices(_marked, T.StringType(), pa.string())


def repair(text: str) -> str:
    """UTF-8 that was read as Latin-1, read again; what doesn't decode is dropped, and the result is composed."""
    if re.search("Ã|Â|â€|�", text):
        text = text.encode("latin-1", "ignore").decode("utf-8", "ignore") or text
    return unicodedata.normalize("NFC", text)


def sentence_case_text(text: str) -> str:
    """Lower case, but a capital at the start and after a closing mark."""
    out, fresh = [], True
    for c in text.lower():
        out.append(c.upper() if fresh and c.isalpha() else c)
        fresh = c in ".!?\n" or fresh and not c.isalnum()
    return "".join(out)


def embedding_text(text: str) -> str:
    """Repair, spaces, space after marks, sentence case, repeated sentences once."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", repair(text)))).strip()
    text = sentence_case_text(re.sub(r"([.!?])(?=\S)", r"\1 ", text))
    seen: dict[str, str] = {}
    for s in re.split(r"(?<=[.!?])\s+", text):
        seen.setdefault(s.casefold(), s)
    return " ".join(seen.values())


def _said_once(words: list[str], most: int) -> list[str]:
    """At each place the longest group of 2 to ``most`` words that comes again at once loses its second copy, as often as it can."""
    low = [w.lower() for w in words]
    if len(set(zip(low, low[1:], strict=False))) >= len(low) - 1:  # a group said again repeats its first two words
        return words
    ahead, out = deque(words), []
    while ahead:
        near = [w.lower() for w in islice(ahead, 2 * most)]
        n = next((k for k in range(min(most, len(near) // 2), 1, -1) if near[:k] == near[k : 2 * k]), 0)
        if n:
            ahead.rotate(-n)
            for _ in range(n):
                ahead.popleft()
            ahead.rotate(n)
        else:
            out.append(ahead.popleft())
    return out


def local_repeats(text: str, most: int = 8) -> str:
    """Groups of words said twice in a row stay once, within each stretch between closing marks; marks are part of no stretch."""
    parts = re.split(r"([.!?…]+)", text)
    return "".join(p if k % 2 or not p.strip() else " ".join(_said_once(p.split(), most)) for k, p in enumerate(parts))


def sanitize_text(text: str) -> str:
    """Composed, without fillers, straight apostrophes, no space before low marks, first letter in upper case."""
    text = unicodedata.normalize("NFC", text).replace("’", "'")
    text = re.sub(rf"(?i)\b(?:{any_of(FILLERS)})\b,? ?", "", text)
    text = re.sub(r"\s+([,.])", r"\1", re.sub(r"[ \t]+", " ", text)).strip().removesuffix(" -")
    return text[:1].upper() + text[1:]


# An entity that speech recognition writes as one word.
ENTITIES = ((r"\bLIA\b", "l’IA"),)


def repair_marks(text: str) -> str:
    for pattern, replacement in MARKS:
        text = re.sub(pattern, replacement.replace("$1", r"\1"), text)
    return text.strip(" ")


def human_text(text: str, most: int = 6, glossary: dict[str, str] | None = None) -> str:
    """Marks repaired, then repeats removed, entities written out and the glossary's terms replaced as whole words."""
    text = local_repeats(repair_marks(text.strip()), most)
    for pattern, replacement in ENTITIES:
        text = re.sub(pattern, replacement, text)
    for term, replacement in (glossary or {}).items():
        if term and replacement is not None:
            text = re.sub(rf"(?i)\b{re.escape(term)}\b", lambda _, r=replacement: r, text)
    return text


def machine_form(text: str) -> str:
    """Compatibility form without accents, in lower case, quotes straight, only letters, digits and plain marks."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)).translate({0x2019: "'", 0xAB: '"', 0xBB: '"'})
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9'\".,;:!?\s-]", " ", text)).strip()


def polish_case(text: str, keep: tuple[str, ...] = ("ChatGPT", "Spark")) -> str:
    """Sentence case that keeps whole-word names and what stands in guillemets."""
    names = {n.lower(): n for n in keep}
    parts = re.split(r"(«[^»]*»)", text)
    parts = [p if p.startswith("«") else re.sub(r"\w+", lambda m: names.get(m[0].lower(), m[0]), sentence_case_text(p)) for p in parts]
    return "".join(parts)


def _udf(f):
    return by_slices(lambda t: None if t is None else f(t), T.StringType(), pa.string())


fix_mojibake, embed_norm, sentence_case, dedupe_ngrams, sanitize, clean_human, machine_text, polished_case = map(_udf, (repair, embedding_text, sentence_case_text, local_repeats, sanitize_text, human_text, machine_form, polish_case))
