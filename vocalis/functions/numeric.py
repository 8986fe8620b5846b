"""Numbers, ids, hashes and small dictionaries, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent function words by language.
FUNCTION_WORDS = {"de": ("der", "die", "und", "das", "ein", "nicht"), "en": ("the", "of", "and", "is", "that", "with"), "es": ("el", "los", "que", "una", "con", "por"), "fr": ("le", "les", "des", "est", "dans", "avec")}


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def number_words(text: Column, values: dict[str, str]) -> Column:
    """Words of the dictionary as digits, token by token."""

    def one(w: Column) -> Column:
        out = w
        for word, digits in values.items():
            out = F.when(F.lower(w) == word, digits).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def seconds_text(ms: Column) -> Column:
    """Whole milliseconds as the shortest decimal text of seconds, for times that are multiples of 100 ms."""
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.floor(ms % 1000 / 100).cast("string"))


def stable_id(source: Column, t0: Column, t1: Column, speaker: Column) -> Column:
    """The first 12 hex digits of the SHA-1 of the compact sorted JSON of a row's key."""
    parts = (F.lit('{"spk":"'), speaker, F.lit('","src":"'), source, F.lit('","t0":'), seconds_text(t0), F.lit(',"t1":'), seconds_text(F.coalesce(F.nullif(t1, F.lit(0)), t0)), F.lit("}"))
    return F.substring(F.sha1(F.concat(*parts)), 1, 12)


def content_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def stopword_language(text: Column) -> Column:
    """The language with most function words; the first by name of equals, und for none."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def hits(own: tuple[str, ...]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*own)))

    score = {lang: hits(own) for lang, own in FUNCTION_WORDS.items()}
    best = F.greatest(*score.values())
    out = F.when(best == 0, "und")
    for lang, s in sorted(score.items()):
        out = out.when(s == best, lang)
    return out
