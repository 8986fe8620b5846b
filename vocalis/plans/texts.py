"""Text, number and hash functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalis.functions import numeric, preview, text, text_udf
from vocalis.operators import rules
from vocalis.plans.registry import query
from vocalis.sources.adapters import LINES, SEG, lines, segments, table

D = "SELECT doc_id, {0} FROM documents"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def simple(name: str, sql: str, column):
    """A query of one text function over documents, with its SQL."""

    @query(name, f"SELECT doc_id, {sql} AS text FROM documents")
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", column(F.col("text")).alias("text"))


R = "regexp_replace({0}, '{1}', '{2}', 'g')"


def nest(*steps: tuple[str, str], inner: str = "text") -> str:
    for pattern, replacement in steps:
        inner = R.format(inner, pattern.replace("'", "''"), replacement)
    return inner


WORD = r"[\p{L}\p{N}_]+"


def edged(inner: str) -> str:
    """SQL that puts chr(1) before and chr(2) after each word: RE2 has no look-around, and its \\b knows ASCII only."""
    return f"regexp_replace({inner}, '({WORD})', chr(1) || '\\1' || chr(2), 'g')"


def plain(inner: str) -> str:
    return f"translate({inner}, chr(1) || chr(2), '')"


def replaced(inner: str, pattern: str, replacement: str) -> str:
    """A replacement of whole words in edged SQL text; < and > in the pattern stand for the edges."""
    return f"regexp_replace({inner}, '(?i)' || replace(replace('{pattern}', '<', chr(1)), '>', chr(2)), '{replacement}', 'g')"


def repaired(inner: str) -> str:
    """The repair of marks without look-ahead and back-references."""
    steps = [(r"\.\s*,\s*", ". "), (r",\s*\.", "."), (r",\s*$", ""), (r",\s*\n", "\n"), *[(f"[{c}]{{2,}}", c) for c in ",.!?;:"], (r"[ \t]+([,.!?;:])", r" \1"), (r"([,.!?;:])[ \t]{2,}", r"\1 "), (r"[ \t]{2,}", " ")]
    for pattern, replacement in steps:
        inner = f"regexp_replace({inner}, '{pattern}', " + (f"'{replacement}'" if replacement != "\n" else "chr(10)") + ", 'g')"
    return f"trim({inner})"


def cased(inner: str) -> str:
    parts = f"string_split(regexp_replace(lower({inner}), '([.!?\\n])', '\\1' || chr(1), 'g'), chr(1))"
    lead = "regexp_extract(p, '^[^\\p{L}\\p{N}]*')"
    return f"array_to_string(list_transform({parts}, lambda p: {lead} || upper(substr(p, length({lead}) + 1, 1)) || substr(p, length({lead}) + 2)), '')"


simple("fn_normalize_spaces", "regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')", text.normalize_spaces)
simple("fn_acronyms", plain(replaced(replaced(edged("text"), "<the>", chr(1) + "THE" + chr(2)), "<und>", chr(1) + "UND" + chr(2))), lambda c: text.acronyms(c, ("THE", "UND")))
simple("fn_similarity_key", "trim(" + nest((r"[^a-z0-9à-öø-ÿ\s]", ""), inner="lower(text)") + ")", text.similarity_key)
simple("fn_fix_punct_nobr", "trim(" + nest((r"\s+([,.])", r"\1"), (r"\s*([;:!?])", r" \1"), (r"[ \t]{2,}", " ")) + ")", text.fix_punctuation_plain)
simple("fn_strip_markers", "trim(" + nest((r"\[\d{1,2}:\d{2}(?::\d{2})?\]", ""), (r"<[^>]*>", ""), (r"\[[^\]]*\]", ""), (r"\([^)]*\)", ""), (r"[ \t]+", " ")) + ")", text.strip_markers)
simple("fn_slugify", nest(("^-|-$", ""), inner=nest(("[^a-z0-9]+", "-"), inner="lower(source || ' ' || lang || '!')")), lambda c: text.slug(F.concat("source", F.lit(" "), "lang", F.lit("!"))))
simple("fn_join_text", "array_to_string(list_filter([trim(coalesce(source, '')), '', trim('  ' || lang || ' ')], lambda x: x <> ''), ' ')", lambda c: text.join_text(F.col("source"), F.lit("  "), F.lit(None).cast("string"), F.concat(F.lit("  "), "lang", F.lit(" "))))
simple("fn_control_chars", "trim(" + nest((chr(0xA0), " "), (r"[\x00-\x09\x0B-\x1F]", ""), (" {2,}", " ")) + ")", text.control_free)
simple("fn_terminal_punct", "CASE WHEN trim(text) = '' THEN trim(text) WHEN regexp_matches(trim(text), '[.!?…»\"]$') THEN trim(text) ELSE trim(text) || '.' END", text.terminal_mark)
simple("fn_title", "(SELECT upper(substr(f, 1, 1)) || substr(f, 2, 80) FROM (SELECT regexp_replace(substr(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1], 1, 80), '\\.+$', '') AS f))", text.title)
simple("fn_french_typo", nest((r"\.{3,}", "…"), (r'"([^"]*)"', "« \\1 »"), ("[  ]*([;:!?])", " \\1")), text.french_spacing)
simple("fn_machine_text", "trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(text, '[ßœŒøØæÆ]', '?', 'g'))), '[^a-z0-9''\".,;:!?\\s-]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))", lambda c: text_udf.machine_text(F.regexp_replace(c, "[ßœŒøØæÆ]", "?")))


@query("fn_space_after_punct", f"WITH {LINES} SELECT doc_id, pos, replace(regexp_replace(regexp_replace(line, '([.!?])', '\\1' || chr(1), 'g'), chr(1) || '(\\s|$)', '\\1', 'g'), chr(1), ' ') AS text FROM ln")
def fn_space_after_punct(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", text.space_after_marks(F.col("line")).alias("text"))


@query("fn_split_sentences", f"WITH {SEG}, q AS (SELECT doc_id, idx, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM seg) SELECT doc_id, idx, unnest(range(len(ss)))::BIGINT AS k, unnest(ss) AS sentence FROM q")
def fn_split_sentences(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", "idx", F.posexplode(text.split_sentences(F.col("text"))).alias("k", "sentence")).withColumn("k", F.col("k").cast("long"))


@query("fn_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[a-zA-ZÀ-ÖØ-öø-ÿ0-9]+'))::BIGINT AS n, array_to_string(regexp_extract_all(text, '[a-zA-ZÀ-ÖØ-öø-ÿ0-9]+')[1:8], ' ') AS first FROM documents")
def fn_tokens(spark, sf_dir):
    w = text.words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(F.slice(w, 1, 8), " ").alias("first"))


FOUND = f"list_distinct(regexp_extract_all({edged('text')}, chr(1) || '(\\p{{Lu}}\\p{{Ll}}{{2,}})' || chr(2), 1))"


@query("fn_entities", f"SELECT doc_id, len({FOUND})::BIGINT AS n, array_to_string(list_sort({FOUND}), ' ') AS names FROM documents")
def fn_entities(spark, sf_dir):
    e = text.entities(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(e).cast("long").alias("n"), F.array_join(F.array_sort(e), " ").alias("names"))


@query("fn_build_pattern", "SELECT page_id, '\\b' || array_to_string(list_transform(string_split(regexp_replace(url, '[/?]+', ' ', 'g'), ' '), lambda t: regexp_replace(t, '([.^$*+?()\\[\\]{}|\\\\-])', '\\\\\\1', 'g')), '\\s+') || '\\b' AS pattern FROM pages")
def fn_build_pattern(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.pattern_of(F.split(F.regexp_replace("url", "[/?]+", " "), " ")).alias("pattern"))


def stripped_sql(names: tuple[str, ...]) -> str:
    pattern = "<(?:" + "|".join(n.replace(" ", "> <") for n in names) + ")>,? ?"
    edges = f"replace(replace('{pattern}', '<', chr(1)), '>', chr(2))"
    return f"SELECT doc_id, {plain(replaced(edged('text'), pattern, ''))} AS text, len(regexp_extract_all({edged('text')}, '(?i)' || {edges}))::BIGINT AS hits FROM documents"


for _name, _names in {"fn_fillers": ("the", "and", "der", "la"), "fn_oral_markers": ("of the", "in the")}.items():

    @query(_name, stripped_sql(_names))
    def fillers(spark, sf_dir, names=_names):
        stripped, hits = text.strip_fillers(F.col("text"), names)
        return docs(spark, sf_dir).select("doc_id", stripped.alias("text"), hits.alias("hits"))


@query("fn_md_prefix", f"WITH {LINES} SELECT doc_id, pos, trim(regexp_extract(line, '^\\s*((?:>\\s?|#{{1,6}} |[-*+] |\\d+[.)] )?)(.*)$', 1)) AS prefix, regexp_extract(line, '^\\s*((?:>\\s?|#{{1,6}} |[-*+] |\\d+[.)] )?)(.*)$', 2) AS rest FROM ln")
def fn_md_prefix(spark, sf_dir):
    prefix, rest = text.markdown_line(F.col("line"))
    return lines(spark, sf_dir).select("doc_id", "pos", prefix.alias("prefix"), rest.alias("rest"))


@query("fn_split_speaker", f"WITH {LINES}, x AS (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN 'Speaker_' || (pos % 5)::VARCHAR || ': ' ELSE '' END || line AS line FROM ln) SELECT doc_id, pos, nullif(regexp_extract(line, '^([A-Z][A-Za-z0-9_]{{1,20}}): (.*)$', 1), '') AS speaker, CASE WHEN regexp_extract(line, '^([A-Z][A-Za-z0-9_]{{1,20}}): (.*)$', 1) <> '' THEN regexp_extract(line, '^([A-Z][A-Za-z0-9_]{{1,20}}): (.*)$', 2) ELSE line END AS text FROM x")
def fn_split_speaker(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("line", F.concat(F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Speaker_"), (F.col("pos") % 5).cast("string"), F.lit(": "))).otherwise(""), "line"))
    speaker, rest = text.speaker_prefix(F.col("line"))
    return x.select("doc_id", "pos", speaker.alias("speaker"), rest.alias("text"))


NUMBERS = {"one": "1", "two": "2", "ten": "10", "un": "1", "deux": "2", "the": "0"}


@query("fn_number_words", f"WITH {SEG} SELECT doc_id, idx, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NUMBERS.items()) + " ELSE w END), ' ') AS text FROM seg")
def fn_number_words(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", "idx", numeric.number_words(F.col("text"), NUMBERS).alias("text"))


@query("fn_canonical", "SELECT doc_id, coalesce(m.canonical, d.source) AS source, m.term IS NOT NULL AS preserved FROM documents d LEFT JOIN (VALUES ('src1', 'Source One'), ('src2', 'Source Two')) m(term, canonical) ON lower(trim(d.source)) = m.term")
def fn_canonical(spark, sf_dir):
    terms = spark.createDataFrame([("src1", "Source One"), ("src2", "Source Two")], "term string, canonical string")
    return docs(spark, sf_dir).join(F.broadcast(terms), F.lower(F.trim("source")) == F.col("term"), "left").select("doc_id", F.coalesce("canonical", "source").alias("source"), F.col("term").isNotNull().alias("preserved"))


@query("fn_regex_preview", "SELECT doc_id, len(regexp_extract_all(p, '(?i)th'))::BIGINT AS hits, regexp_replace(p, '(?i)th', 'TH', 'g') AS after FROM (SELECT doc_id, substr(text, 1, 1200) AS p FROM documents)")
def fn_regex_preview(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 1200).alias("p"))
    return p.select("doc_id", F.regexp_count("p", F.lit("(?i)th")).cast("long").alias("hits"), rules.apply(F.col("p"), [("th", "TH")]).alias("after"))


# DuckDB compares bytes: letters beyond ASCII become control characters first, one for one.
ONE_BYTE = "translate({0}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', " + " || ".join(f"chr({k})" for k in (*range(1, 9), *range(14, 27))) + ")"


@query("fn_levenshtein", f"WITH {SEG}, x AS (SELECT doc_id, idx, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM seg), y AS (SELECT doc_id, idx, levenshtein({ONE_BYTE.format('a')}, {ONE_BYTE.format('b')}) AS d, greatest(length(a), length(b)) AS n FROM x WHERE b IS NOT NULL) SELECT doc_id, idx, d::BIGINT AS distance, d / n AS normalized FROM y")
def fn_levenshtein(spark, sf_dir):
    after = F.lead("text").over(W.partitionBy("doc_id").orderBy("idx"))
    pairs = segments(spark, sf_dir).select("doc_id", "idx", F.col("text").alias("a"), after.alias("b")).where("b IS NOT NULL")
    return pairs.select("doc_id", "idx", F.levenshtein("a", "b").cast("long").alias("distance"), numeric.edit_ratio(F.col("a"), F.col("b")).alias("normalized"))


@query("fn_token_estimate", "SELECT doc_id, greatest(1, ceil((CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END) * 13 / 10))::BIGINT AS tokens FROM documents")
def fn_token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("fn_time_formats", f"WITH {SEG} SELECT doc_id, idx, lpad((t1 // 60000)::VARCHAR, 2, '0') || ':' || lpad((t1 // 1000 % 60)::VARCHAR, 2, '0') AS mmss, lpad((t1 // 3600000)::VARCHAR, 2, '0') || ':' || lpad((t1 // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((t1 // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((t1 % 1000)::VARCHAR, 3, '0') AS srt FROM seg")
def fn_time_formats(spark, sf_dir):
    from vocalis.sources.formats import minutes, stamp

    return segments(spark, sf_dir).select("doc_id", "idx", minutes(F.col("t1")).alias("mmss"), stamp(F.col("t1"), ",").alias("srt"))


@query("fn_stable_id", f"WITH {SEG} SELECT doc_id, idx, substr(sha1('{{\"spk\":\"' || speaker || '\",\"src\":\"d' || doc_id::VARCHAR || '\",\"t0\":' || (t0 // 1000)::VARCHAR || '.' || (t0 % 1000 // 100)::VARCHAR || ',\"t1\":' || (t1 // 1000)::VARCHAR || '.' || (t1 % 1000 // 100)::VARCHAR || '}}'), 1, 12) AS id FROM seg")
def fn_stable_id(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", "idx", numeric.stable_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("t0"), F.col("t1"), F.col("speaker")).alias("id"))


@query("fn_doc_id", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '_' || substr(sha1(url), 1, 8) AS doc_id FROM pages")
def fn_doc_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(text.slug(F.col("url")), F.lit("_"), F.substring(F.sha1("url"), 1, 8)).alias("doc_id"))


@query("fn_row_hash", "SELECT doc_id, sha256(doc_id::VARCHAR || '|' || coalesce(lang, '') || '|' || coalesce(source, '') || '|' || text) AS hash FROM documents")
def fn_row_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", numeric.content_hash("doc_id", "lang", "source", "text").alias("hash"))


@query("fn_json_roundtrip", "SELECT event_id, coalesce((props->>'$.k')::BIGINT, -1) AS k, '{\"k\":' || (props->>'$.k') || '}' AS encoded FROM events")
def fn_json_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), F.to_json("p").alias("encoded"))


SANITIZED = plain(replaced(edged("replace(text, '’', chr(39))"), "<(?:euh|heu|bah|ben|hum)>,? ?", ""))
for _pattern, _replacement in ((r"[ \t]+", " "), (r"\s+([,.])", r"\1"), (r"^\s+|\s+$", ""), (" -$", "")):
    SANITIZED = R.format(SANITIZED, _pattern, _replacement)

simple_turn = {
    "fn_sanitize": (f"(SELECT upper(substr(f, 1, 1)) || substr(f, 2) FROM (SELECT trim({SANITIZED}) AS f))", text.sanitize),
    "fn_fix_punct": (repaired("text"), text.fix_punctuation),
    "fn_sentence_case": (cased("text"), text.sentence_case),
}
for _name, (_sql, _function) in simple_turn.items():

    @query(_name, f"WITH {SEG} SELECT doc_id, idx, {_sql} AS text FROM seg")
    def turned(spark, sf_dir, function=_function):
        return segments(spark, sf_dir).select("doc_id", "idx", function(F.col("text")).alias("text"))


# Functions that SQL can't express.
for _name, _function in {"fn_repeat_words": text.collapse_repeats, "fn_fix_mojibake": text_udf.fix_mojibake, "fn_embed_norm": text_udf.embed_norm, "fn_clean_human": text_udf.clean_human, "udf_sentence_case": text_udf.polished_case}.items():

    @query(_name)
    def custom(spark, sf_dir, function=_function):
        return segments(spark, sf_dir).select("doc_id", "idx", function(F.col("text")).alias("text"))


SCORES = {lang: f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in own)})))" for lang, own in numeric.FUNCTION_WORDS.items()}
LANG_SQL = "WITH d AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS ws FROM documents), s AS (SELECT doc_id, " + ", ".join(f'{sql} AS "{lang}"' for lang, sql in SCORES.items()) + " FROM d) SELECT doc_id, CASE WHEN greatest(" + ", ".join(f'"{k}"' for k in SCORES) + ") = 0 THEN 'und' " + " ".join(f'WHEN "{k}" = greatest({", ".join(chr(34) + j + chr(34) for j in SCORES)}) THEN \'{k}\'' for k in sorted(SCORES)) + " END AS lang FROM s"


@query("udf_lang", LANG_SQL)
def udf_lang(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", numeric.stopword_language(F.col("text")).alias("lang"))


@query("fmt_final_text", f"WITH {SEG} SELECT doc_id, string_agg(speaker || ' : ' || trim(text), chr(10) || chr(10) ORDER BY idx) AS body FROM seg WHERE trim(text) <> '' GROUP BY doc_id")
def fmt_final_text(spark, sf_dir):
    from vocalis.sources.formats import joined_lines

    s = segments(spark, sf_dir).where(F.trim("text") != "")
    return joined_lines(s, F.concat("speaker", F.lit(" : "), F.trim("text")), "\n\n")


@query("fn_rule_diff", "WITH t AS (SELECT doc_id, text, regexp_replace(text, '[aeiou]([mnr])', '<\\1>', 'g') AS after FROM documents) SELECT doc_id, sha256(after) AS after_sha256, text <> after AS changed, len(regexp_extract_all(text, '[aeiou]([mnr])'))::BIGINT AS hits FROM t")
def fn_rule_diff(spark, sf_dir):
    """A rule on whole documents: its hits, and the text that its unified diff leads to when it is applied to the document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", preview.preview(F.col("text"), "[aeiou]([mnr])", r"<\1>", ignore_case=False, limit_ms=10_000).alias("p"))
    return d.select("doc_id", F.sha2(preview.patch("text", "p.diff").cast("binary"), 256).alias("after_sha256"), (F.col("p.diff") != "").alias("changed"), "p.hits")
