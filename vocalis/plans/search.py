"""The lexical index and searches over it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.operators import index, match
from vocalis.plans.registry import query
from vocalis.sources import files, index_store
from vocalis.sources.adapters import SEG, row_id, segments

INDEX = f"""{SEG}, tm0 AS (SELECT doc_id::VARCHAR || '-' || idx::VARCHAR AS chunk_id, list_filter(regexp_split_to_array(translate(lower(text), '{index.ACCENTED}', '{index.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ts FROM seg),
tm AS (SELECT chunk_id, unnest(ts) AS term, unnest(range(len(ts)))::INT AS pos FROM tm0), po AS (SELECT term, chunk_id, count(*) AS tf FROM tm GROUP BY term, chunk_id), ln AS (SELECT chunk_id, sum(tf)::BIGINT AS n FROM po GROUP BY chunk_id)"""


def built(spark, sf_dir) -> index.Index:
    s = segments(spark, sf_dir)
    return index.build(s.select(row_id(F.col("doc_id"), F.col("idx")).alias("chunk_id"), "text"))


@query("ix_postings", f"WITH {INDEX} SELECT term, chunk_id, tf FROM po")
def ix_postings(spark, sf_dir):
    return built(spark, sf_dir).postings.select("term", "chunk_id", "tf")


@query("ix_match_and", f"WITH {INDEX} SELECT chunk_id FROM po WHERE term IN ('the', 'of', 'and') GROUP BY chunk_id HAVING count(*) = 3")
def ix_match_and(spark, sf_dir):
    return index.match_all(built(spark, sf_dir), ["the", "of", "and"])


@query("ix_match_or", f"WITH {INDEX} SELECT DISTINCT chunk_id FROM po WHERE term IN ('der', 'la')")
def ix_match_or(spark, sf_dir):
    return index.match_any(built(spark, sf_dir), ["der", "la"])


@query("ix_match_not", f"WITH {INDEX} SELECT chunk_id FROM po WHERE term = 'the' AND chunk_id NOT IN (SELECT chunk_id FROM po WHERE term = 'that')")
def ix_match_not(spark, sf_dir):
    return index.match_not(built(spark, sf_dir), "the", "that")


@query("ix_match_prefix", f"WITH {INDEX} SELECT DISTINCT chunk_id FROM po WHERE starts_with(term, 'ther')")
def ix_match_prefix(spark, sf_dir):
    return index.match_prefix(built(spark, sf_dir), "ther")


@query("ix_match_phrase", f"WITH {INDEX} SELECT DISTINCT a.chunk_id FROM tm a JOIN tm b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def ix_match_phrase(spark, sf_dir):
    return index.match_phrase(built(spark, sf_dir), ["of", "the"])


@query("topk_bm25", f"""WITH {INDEX}, c AS (SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM ln), d AS (SELECT term, count(*) AS df FROM po WHERE term IN ('the', 'is') GROUP BY term), m AS (SELECT chunk_id FROM po WHERE term IN ('the', 'is') GROUP BY chunk_id HAVING count(*) = 2),
s AS (SELECT chunk_id, round(sum(-greatest(0.000001, ln((documents - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (total / documents)))), 6) AS score FROM po JOIN m USING (chunk_id) JOIN d USING (term) JOIN ln USING (chunk_id), c GROUP BY chunk_id) SELECT chunk_id, score FROM s ORDER BY score, chunk_id LIMIT 10""")
def topk_bm25(spark, sf_dir):
    return index.bm25(built(spark, sf_dir), ["the", "is"], 10)


@query("val_probe_queries", f"WITH {INDEX} SELECT probe, EXISTS (SELECT 1 FROM po WHERE term = probe) AS found FROM (VALUES ('the'), ('installation'), ('der')) p(probe)")
def val_probe_queries(spark, sf_dir):
    probes = spark.createDataFrame([("the",), ("installation",), ("der",)], "probe string")
    known = built(spark, sf_dir).postings.where(F.col("term").isin("the", "installation", "der")).select(F.col("term").alias("probe")).distinct().withColumn("hit", F.lit(True))
    return probes.join(known, "probe", "left").select("probe", F.coalesce("hit", F.lit(False)).alias("found"))


@query("ix_accent_fold", f"SELECT word, translate(lower(word), '{index.ACCENTED}', '{index.PLAIN}') AS folded, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS word FROM conversations UNION ALL SELECT upper(unnest(regexp_extract_all(replace(text, 'ß', 'ss'), '\\p{{L}}+'))) FROM conversations) GROUP BY word")
def ix_accent_fold(spark, sf_dir):
    """Every word of the corpus, as written and in capitals, as the index has it."""
    found = lambda text: segments(spark, sf_dir).select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    both = found(F.col("text")).unionByName(found(F.replace("text", F.lit("ß"), F.lit("ss"))).select(F.upper("word").alias("word")))
    return both.groupBy("word").agg(F.count("*").alias("n")).select("word", index.fold(F.col("word")).alias("folded"), "n")


FIELDS = ["speaker", "text"]
# Query texts over the corpus' most common words of three letters or more, {0} the most common; {0:2} is the start of one. Each has
# its chunks in SQL: T a word, P a phrase, S words with a start, N near words (their numbers, then the distance), F a word in a field.
FORMS = [
    ("{0}", "T0"),
    ("{0} {1}", "T0 INTERSECT T1"),
    ("{0} AND {2}", "T0 INTERSECT T2"),
    ("{3} OR {4}", "T3 UNION T4"),
    ("{0} NOT {1}", "T0 EXCEPT T1"),
    ("{0} {1} NOT {2}", "(T0 INTERSECT T1) EXCEPT T2"),
    ("{3} OR {4} AND {5}", "T3 UNION (T4 INTERSECT T5)"),
    ("({3} OR {4}) AND {5}", "(T3 UNION T4) INTERSECT T5"),
    ("{3} OR {4} NOT {5}", "T3 UNION (T4 EXCEPT T5)"),
    ("{3} AND {4} NOT {5}", "T3 INTERSECT (T4 EXCEPT T5)"),
    ("{6} ({7} OR {8}) NOT ({9} OR {10})", "(T6 INTERSECT (T7 UNION T8)) EXCEPT (T9 UNION T10)"),
    ('"{0} {1}"', "P0_1"),
    ('"{1} {0}" OR {11}', "P1_0 UNION T11"),
    ("{0} + {2}", "P0_2"),
    ('{12} NOT "{12} {0}"', "T12 EXCEPT P12_0"),
    ("{6:3}*", "S6_3"),
    ("{7:2}* NOT {7}", "S7_2 EXCEPT T7"),
    ("{13:1}* AND {14:2}*", "S13_1 INTERSECT S14_2"),
    ("NEAR({0} {1}, 2)", "N0_1_2"),
    ("NEAR({0} {1})", "N0_1_10"),
    ("NEAR({2} {3}, 0) OR NEAR({4} {5}, 25)", "N2_3_0 UNION N4_5_25"),
    ("{0} NOT NEAR({0} {1}, 4)", "T0 EXCEPT N0_1_4"),
    ("^{0}", "F0_text_0"),
    ("^{1} OR ^{2}", "F1_text_0 UNION F2_text_0"),
    ("text : {0}", "F0_text_9"),
    ("speaker : user", "U"),
    ("- text : {0}", "F0_speaker_9"),
    ("{{speaker text}} : {15}", "T15"),
    ("text : ({0} OR {16}) NOT speaker : user", "(F0_text_9 UNION F16_text_9) EXCEPT U"),
    ("- {{text}} : user AND {17}", "U INTERSECT T17"),
]


def _filled(form: str, words: Column) -> Column:
    parts = []
    for piece in re.split(r"(\{\d+(?::\d+)?\})", form):
        if m := re.fullmatch(r"\{(\d+)(?::(\d+))?\}", piece):
            word = F.try_element_at(words, F.lit(int(m[1]) + 1))
            parts.append(F.substring(word, 1, int(m[2])) if m[2] else word)
        elif piece:
            parts.append(F.lit(piece.replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts)


def _set(code: str) -> str:
    if code == "U":
        return "(SELECT chunk_id FROM fm WHERE field = 'speaker' AND term = 'user')"
    kind, *at = code[0], *code[1:].split("_")
    if kind == "T":
        return f"(SELECT chunk_id FROM h WHERE k = {at[0]})"
    if kind == "F":
        return f"(SELECT chunk_id FROM h WHERE k = {at[0]} AND field = '{at[1]}'{' AND pos = 0' if at[2] == '0' else ''})"
    if kind == "P":
        return f"(SELECT a.chunk_id FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.k = {at[0]} AND b.k = {at[1]})"
    if kind == "S":
        return f"(SELECT chunk_id FROM fm WHERE starts_with(term, (SELECT term[1:{at[1]}] FROM top WHERE k = {at[0]})))"
    return f"(SELECT a.chunk_id FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND a.field = b.field AND abs(a.pos - b.pos) - 1 <= {at[2]} WHERE a.k = {at[0]} AND b.k = {at[1]})"


FIELD_WORDS = f"""fm0 AS (SELECT doc_id::VARCHAR || '-' || idx::VARCHAR AS chunk_id, unnest([{{'field': 'speaker', 'v': speaker}}, {{'field': 'text', 'v': text}}], recursive := true) FROM seg),
fm1 AS (SELECT chunk_id, field, list_filter(regexp_split_to_array(translate(lower(v), '{index.ACCENTED}', '{index.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ts FROM fm0),
fm AS (SELECT chunk_id, field, unnest(ts) AS term, unnest(range(len(ts)))::INT AS pos FROM fm1),
top AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS k FROM fm WHERE field = 'text' AND length(term) >= 3 GROUP BY term QUALIFY k < 18),
h AS (SELECT k, chunk_id, field, pos FROM fm JOIN top USING (term))"""
FORMS_SQL = f"WITH {SEG}, {FIELD_WORDS} " + " UNION ALL ".join(f"SELECT '{k}' AS query_id, chunk_id FROM ({re.sub(r'(?<![A-Z])([TPSNF][0-9][a-z0-9_]*|U(?![A-Z]))', lambda m: _set(m[0]), sql)})" if " " in sql else f"SELECT DISTINCT '{k}' AS query_id, chunk_id FROM {_set(sql)}" for k, (_, sql) in enumerate(FORMS))


def form_queries(words: DataFrame) -> DataFrame:
    """(query_id, query) of FORMS, from the words of a table (term, n): its 18 most common of three letters or more."""
    top = words.where(F.length("term") >= 3).orderBy(F.desc("n"), "term").limit(18)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "term"))), lambda r: r["term"])
    forms = F.array(*[F.struct(F.lit(str(k)).alias("query_id"), _filled(form, F.col("w")).alias("query")) for k, (form, _) in enumerate(FORMS)])
    return top.agg(ranked.alias("w")).select(F.inline(forms))


def stored(spark, sf_dir) -> index_store.Store:
    """The segments as chunks with two fields, stored by three additions and a removal: the last batch comes once too early, with other texts."""
    path = f"{files.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    s = segments(spark, sf_dir).select(row_id(F.col("doc_id"), F.col("idx")).alias("chunk_id"), "speaker", "text")
    early = F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0
    index_store.append(spark, path, s.where(early).withColumn("text", F.reverse("text")), FIELDS)
    index_store.append(spark, path, s.where(~early), FIELDS)
    index_store.delete(spark, path, s.where(early & (F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0)).select("chunk_id"))
    return index_store.append(spark, path, s.where(early), FIELDS)


def stored_queries(store: index_store.Store) -> DataFrame:
    return form_queries(store.postings().where("field = 'text'").groupBy("term").agg(F.sum(F.size("positions")).alias("n")))


@query("ix_match_text", FORMS_SQL)
def ix_match_text(spark, sf_dir):
    """Thirty queries as text, over an index that three additions and a removal have made."""
    store = stored(spark, sf_dir)
    return store.search(stored_queries(store)).select("query_id", "chunk_id")
