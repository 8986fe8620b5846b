"""Text functions as columns: built-ins only, so that they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of French words, fillers, markers and broken encodings.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
MOJIBAKE = "Ã|Â|â€|�"
FILLERS = ("euh", "heu", "bah", "ben", "hum")
ORAL_MARKERS = ("du coup", "en fait", "voilà", "quoi")


#: Edges of whole words, for letters of any script.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


#: Letters whose upper case is several letters (ß: SS), and the one capital that a first letter takes; without one it stays.
SEVERAL = "".join(c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1)
CAPITALS = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in SEVERAL)


def capital(letter: Column) -> Column:
    """One letter in upper case, always one letter."""
    return F.when(F.length(F.upper(letter)) > F.length(letter), F.translate(letter, SEVERAL, CAPITALS)).otherwise(F.upper(letter))


def template(text: str, values: dict[str, Column]) -> Column:
    """Fills {name}; a name without a value stays as it is."""
    parts = [values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) and p[1:-1] in values else F.lit(p) for p in re.split(r"(\{\w+\})", text) if p]
    return F.concat(*parts) if parts else F.lit("")


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def has_mojibake(text: Column) -> Column:
    return text.rlike(MOJIBAKE)


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def normalize_spaces(text: Column) -> Column:
    """One blank between words, none around line ends, at most one blank line."""
    return chain(text, (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))


def space_after_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"([.!?])(?=\S)", "$1 ")


def acronyms(text: Column, names: tuple[str, ...]) -> Column:
    return chain(text, *[(rf"(?iu){BEFORE}{n}{AFTER}", n) for n in names])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{LETTERS}0-9]+"), F.lit(0))


def entities(text: Column) -> Column:
    """Capitalised words of three letters and more, distinct in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{BEFORE}\p{{Lu}}\p{{Ll}}{{2,}}{AFTER}"), F.lit(0)))


def pattern_of(tokens: Column) -> Column:
    """A regex for the tokens in a row, with special characters escaped."""
    escaped = F.transform(tokens, lambda t: F.regexp_replace(t, r"([.^$*+?()\[\]{}|\\-])", r"\\$1"))
    return F.concat(F.lit(r"\b"), F.array_join(escaped, r"\s+"), F.lit(r"\b"))


def any_of(names: tuple[str, ...]) -> str:
    return "|".join(re.escape(n).replace(r"\ ", " ") for n in names)


def strip_fillers(text: Column, names: tuple[str, ...] = FILLERS) -> tuple[Column, Column]:
    """The text without fillers, and how many there were."""
    pattern = rf"(?iu){BEFORE}(?:{any_of(names)}){AFTER},? ?"
    return F.regexp_replace(text, pattern, ""), F.regexp_count(text, F.lit(pattern)).cast("long")


def collapse_repeats(text: Column) -> Column:
    """A word said several times in a row stays once."""
    return F.regexp_replace(text, r"(?iU)\b([\w'’-]+)(\s+\1\b)+", "$1")


def similarity_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9à-öø-ÿ\s]", ""))


# How marks are repaired, in this order.
MARKS = (
    (r"\.\s*,\s*", ". "),
    (r",\s*\.", "."),
    (r",\s*(?=$|\n)", ""),
    (r"([,.!?;:])\1+", "$1"),
    (r"[ \t]+([,.!?;:])", " $1"),
    (r"([,.!?;:])[ \t]{2,}", "$1 "),
    (r"[ \t]{2,}", " "),
)


def fix_punctuation(text: Column) -> Column:
    """Dot and comma in a row become one, commas at line ends go, doubled marks stay once, blanks around marks are single."""
    return F.trim(chain(text, *MARKS))


def fix_punctuation_plain(text: Column) -> Column:
    """Low marks close up, high marks have one blank before them."""
    return F.trim(chain(text, (r"\s+([,.])", "$1"), (r"\s*([;:!?])", " $1"), (r"[ \t]{2,}", " ")))


def sentence_case(text: Column) -> Column:
    """Lower case, but a capital at the start and after a closing mark, whatever signs stand between."""
    parts = F.split(F.lower(text), r"(?<=[.!?\n])")

    def opened(part: Column) -> Column:
        lead = F.regexp_extract(part, r"^[^\p{L}\p{N}]*", 0)
        at = F.length(lead) + 1
        return F.concat(lead, capital(F.substr(part, at, F.lit(1))), F.substr(part, at + 1))

    return F.array_join(F.transform(parts, opened), "")


def sanitize(text: Column) -> Column:
    """Without fillers, straight apostrophes, no space before low marks, first letter in upper case; for composed text."""
    text, _ = strip_fillers(F.regexp_replace(text, "’", "'"))
    text = F.trim(chain(text, (r"[ \t]+", " "), (r"\s+([,.])", "$1"), (r"^\s+|\s+$", ""), (r" -$", "")))
    return F.concat(capital(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def markdown_line(line: Column) -> tuple[Column, Column]:
    """A line's prefix (quote, heading, list or number) and the rest."""
    pattern = r"^\s*((?:>\s?|#{1,6} |[-*+] |\d+[.)] )?)(.*)$"
    return F.trim(F.regexp_extract(line, pattern, 1)), F.regexp_extract(line, pattern, 2)


def speaker_prefix(line: Column) -> tuple[Column, Column]:
    pattern = r"^([A-Z][A-Za-z0-9_]{1,20}): (.*)$"
    speaker = F.regexp_extract(line, pattern, 1)
    return F.nullif(speaker, F.lit("")), F.when(speaker != "", F.regexp_extract(line, pattern, 2)).otherwise(line)


def strip_markers(line: Column) -> Column:
    """Without time stamps, bracketed and parenthesised notes and tags."""
    return F.trim(chain(line, (r"\[\d{1,2}:\d{2}(?::\d{2})?\]", ""), (r"<[^>]*>", ""), (r"\[[^\]]*\]", ""), (r"\([^)]*\)", ""), (r"[ \t]+", " ")))


def join_text(*parts: Column) -> Column:
    trimmed = F.transform(F.array(*parts), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), " ")


def terminal_mark(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", t).when(t.rlike(r"[.!?…»\"]$"), t).otherwise(F.concat(t, F.lit(".")))


def french_spacing(text: Column) -> Column:
    """Ellipsis as one sign, guillemets for quotes, a no-break space before high marks."""
    return chain(text, (r"\.{3,}", "…"), (r"\"([^\"]*)\"", "« $1 »"), (r"[  ]*([;:!?])", " $1"))


def title(text: Column, most: int = 80) -> Column:
    """The first sentence, cut to ``most`` characters, without final dots, its first letter in upper case."""
    first = F.regexp_replace(F.substring(F.element_at(split_sentences(text), 1), 1, most), r"\.+$", "")
    return F.concat(capital(F.substring(first, 1, 1)), F.substring(first, 2, most))


def control_free(text: Column) -> Column:
    return F.trim(chain(text, (r" ", " "), (r"[\x00-\x09\x0B-\x1F]", ""), (r" {2,}", " ")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def token_estimate(text: Column) -> Column:
    """ceil(1.3 * words), at least 1."""
    n = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    return F.greatest(F.lit(1), F.ceil(n * 13 / 10)).cast("long")
