"""Window functions, islands and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalis.functions import text, text_udf
from vocalis.operators import folds, sequences
from vocalis.operators.islands import collapse, islands, previous
from vocalis.plans.registry import query
from vocalis.sources.adapters import SEG, UTT, segment_words, segments, table, utterances


def greedy_sql(size: str, limit: int, carry: str, least_rows: int = 1) -> str:
    """Recursive CTEs: ``ck`` has the first and last row (from 1) of each greedy chunk; ``carry`` gives the next chunk's first row."""
    ends = "list_min(list_filter(range({0}, n + 1), lambda i: pp[i + 1] - pp[{1}] >= {2} AND i - {1} + 1 >= {3}))"
    return f"""WITH RECURSIVE {SEG}, r0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i, sum({size}) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS p FROM seg),
r AS (SELECT doc_id, list_concat([0::BIGINT], list(p ORDER BY i)) AS pp, max(i) AS n FROM r0 GROUP BY doc_id),
ck AS (SELECT doc_id, 0::BIGINT AS chunk, 1::BIGINT AS a, coalesce(e, n)::BIGINT AS b, e IS NOT NULL AS closed, pp, n FROM (SELECT *, {ends.format(1, 1, limit, least_rows)} AS e FROM r)
UNION ALL SELECT doc_id, chunk + 1, s, coalesce(e, n)::BIGINT, e IS NOT NULL, pp, n FROM (SELECT *, {ends.format('b + 1', 's', limit, least_rows)} AS e FROM (SELECT *, ({carry})::BIGINT AS s FROM ck WHERE closed)))"""


RAG = greedy_sql("words", 60, "coalesce(list_max(list_filter(range(a, b + 1), lambda q: pp[b + 1] - pp[q] >= 20)), a)")


@query("fold_rag_chunks", f"{RAG} SELECT doc_id, chunk, a, b FROM ck")
def fold_rag_chunks(spark, sf_dir):
    return folds.budget_chunks(segments(spark, sf_dir).select("doc_id", "idx", "words"), 60, 20)


@query("agg_rag_chunk", f"{RAG}, sg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i FROM seg) SELECT ck.doc_id, chunk, min(t0) AS t0, max(t1) AS t1, string_agg(text, ' ' ORDER BY i) AS text, string_agg(idx::VARCHAR, ',' ORDER BY i) AS segment_ids, sum(conf) / (count(*) * 100) AS confidence FROM ck JOIN sg ON ck.doc_id = sg.doc_id AND i BETWEEN a AND b GROUP BY ck.doc_id, chunk")
def agg_rag_chunk(spark, sf_dir):
    s = segments(spark, sf_dir)
    return sequences.chunk_rows(s, folds.budget_chunks(s.select("doc_id", "idx", "words"), 60, 20))


TOKEN = greedy_sql("ceil(words * 13 / 10.0)", 90, "b", 2)


@query("fold_token_chunks", f"{TOKEN} SELECT doc_id, chunk, a, b FROM ck")
def fold_token_chunks(spark, sf_dir):
    s = segments(spark, sf_dir).select("doc_id", "idx", F.ceil(F.col("words") * 13 / 10).alias("tokens"))
    return folds.counted_chunks(s, 90, 60, 2, 1)


def fold_sql(start: str, step: str, columns: str, name: str) -> str:
    """A recursive CTE over numbered utterances u: ``step`` gives the state columns of the next row from (s, x)."""
    return f"WITH RECURSIVE {UTT}, u AS (SELECT *, length(text) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i FROM utt), f(doc_id, i, idx, g, {columns}) AS (SELECT doc_id, i, idx, 0::BIGINT, {start} FROM u x WHERE i = 1 UNION ALL SELECT x.doc_id, x.i, x.idx, {step} FROM f s JOIN u x ON x.doc_id = s.doc_id AND x.i = s.i + 1) SELECT doc_id, idx, g AS {name} FROM f"


_CLOSE = "(x.t1 - s.a > 60000 OR (s.b - s.a >= 30000 AND x.t0 - s.b >= 0) OR (s.b - s.a >= 20000 AND x.t0 - s.b >= 1000))"


@query("fold_sections", fold_sql("x.t0, x.t1", f"s.g + CASE WHEN {_CLOSE} THEN 1 ELSE 0 END, CASE WHEN {_CLOSE} THEN x.t0 ELSE s.a END, x.t1", "a, b", "section"))
def fold_sections(spark, sf_dir):
    return folds.sections(utterances(spark, sf_dir).select("doc_id", "idx", "t0", "t1"), 30_000, 60_000, 1_000, 20_000)


_STAY = "(s.who = x.speaker OR x.t1 - x.t0 < 1200)"


@query("fold_turns", fold_sql("x.speaker", f"s.g + CASE WHEN {_STAY} THEN 0 ELSE 1 END, CASE WHEN {_STAY} THEN s.who ELSE x.speaker END", "who", "turn").replace("0::BIGINT, x.speaker", "1::BIGINT, x.speaker"))
def fold_turns(spark, sf_dir):
    return folds.stable_turns(utterances(spark, sf_dir).select("doc_id", "idx", "speaker", "t0", "t1"))


@query("fold_short_merge", fold_sql("x.t1", "s.g + CASE WHEN x.t1 - x.t0 < 1500 AND x.t0 - s.b <= 200 THEN 0 ELSE 1 END, x.t1", "b", "\"group\"").replace("0::BIGINT, x.t1", "1::BIGINT, x.t1"))
def fold_short_merge(spark, sf_dir):
    return folds.short_merge(utterances(spark, sf_dir).select("doc_id", "idx", "t0", "t1"))


_PARA = "(s.who <> x.speaker OR s.n >= 4 OR s.c + x.chars > 400)"


@query("fold_paragraphs", fold_sql("x.speaker, 1::BIGINT, x.chars::BIGINT", f"s.g + CASE WHEN {_PARA} THEN 1 ELSE 0 END, x.speaker, CASE WHEN {_PARA} THEN 1 ELSE s.n + 1 END, CASE WHEN {_PARA} THEN x.chars ELSE s.c + x.chars END", "who, n, c", "paragraph"))
def fold_paragraphs(spark, sf_dir):
    return folds.paragraphs(utterances(spark, sf_dir).select("doc_id", "idx", "speaker", F.length("text").cast("long").alias("chars")))


@query("win_limit_speakers", f"WITH {UTT}, q AS (SELECT doc_id, speaker, row_number() OVER (PARTITION BY doc_id ORDER BY min(idx)) AS r FROM utt GROUP BY doc_id, speaker) SELECT doc_id, idx, 'SPEAKER_' || lpad((least(r, 2) - 1)::VARCHAR, 2, '0') AS label FROM utt JOIN q USING (doc_id, speaker)")
def win_limit_speakers(spark, sf_dir):
    return sequences.limit_speakers(utterances(spark, sf_dir).select("doc_id", "idx", "speaker"), 2)


ISLAND = UTT + """, g AS (SELECT *, CASE WHEN {0} THEN 0 ELSE 1 END AS fresh FROM (SELECT *, lag(speaker) OVER w AS ls, lag(t1) OVER w AS lt FROM utt WINDOW w AS (PARTITION BY doc_id ORDER BY idx))),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS island FROM g) SELECT doc_id, island, min(t0) AS t0, max(t1) AS t1, arg_min(speaker, idx) AS speaker, string_agg(text, ' ' ORDER BY idx) AS text, count(*) AS n FROM i GROUP BY doc_id, island"""


@query("win_merge_short", "WITH " + ISLAND.format("ls = speaker AND t0 - lt <= 300 AND t1 - t0 <= 8000"))
def win_merge_short(spark, sf_dir):
    u = utterances(spark, sf_dir)
    return collapse(islands(u, (previous("speaker") == F.col("speaker")) & (F.col("t0") - previous("t1") <= 300) & (F.col("t1") - F.col("t0") <= 8000)))


@query("win_polish_join", "WITH " + ISLAND.format("ls = speaker AND t0 - lt <= 650"))
def win_polish_join(spark, sf_dir):
    return collapse(islands(utterances(spark, sf_dir), (previous("speaker") == F.col("speaker")) & (F.col("t0") - previous("t1") <= 650)))


@query("win_speaker_runs", "WITH " + ISLAND.format("ls = speaker"))
def win_speaker_runs(spark, sf_dir):
    return collapse(islands(utterances(spark, sf_dir), previous("speaker") == F.col("speaker")))


@query("win_lag_lead", f"WITH {SEG} SELECT doc_id, idx, lag(doc_id::VARCHAR || '-' || idx::VARCHAR) OVER w AS previous_id, lead(doc_id::VARCHAR || '-' || idx::VARCHAR) OVER w AS next_id FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY idx)")
def win_lag_lead(spark, sf_dir):
    w = W.partitionBy("doc_id").orderBy("idx")
    s = segments(spark, sf_dir).select("doc_id", "idx", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("id"))
    return s.select("doc_id", "idx", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


@query("win_exact_repeat", f"WITH {UTT}, x AS (SELECT doc_id, idx, text, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM utt) SELECT doc_id, idx, text FROM x WHERE text = before")
def win_exact_repeat(spark, sf_dir):
    u = utterances(spark, sf_dir).withColumn("before", previous("text"))
    return u.where("text = before").select("doc_id", "idx", "text")


# DuckDB compares bytes: letters beyond ASCII become control characters first, one for one.
ONE_BYTE = "translate({0}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', " + " || ".join(f"chr({k})" for k in (*range(1, 9), *range(14, 27))) + ")"


@query("win_overlap_pair", f"WITH {SEG}, x AS (SELECT doc_id, idx, substr(text, 1, 40) AS head, lag(right(text, 40)) OVER (PARTITION BY doc_id ORDER BY idx) AS tail FROM seg), y AS (SELECT doc_id, idx, levenshtein({ONE_BYTE.format('tail')}, {ONE_BYTE.format('head')}) AS d, greatest(length(tail), length(head)) AS n FROM x WHERE tail IS NOT NULL) SELECT doc_id, idx, d::BIGINT AS distance, d / n AS normalized FROM y")
def win_overlap_pair(spark, sf_dir):
    """The seam of two neighbouring rows: the last 40 signs of one against the first 40 of the next."""
    w = W.partitionBy("doc_id").orderBy("idx")
    x = segments(spark, sf_dir).select("doc_id", "idx", F.substring("text", 1, 40).alias("head"), F.lag(F.right("text", F.lit(40))).over(w).alias("tail")).where("tail IS NOT NULL")
    d = F.levenshtein("tail", "head")
    return x.select("doc_id", "idx", d.cast("long").alias("distance"), (d / F.greatest(F.length("tail"), F.length("head"))).alias("normalized"))


@query("win_interpolate", f"""WITH {SEG}, q0 AS (SELECT doc_id, idx, t0, t1, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM seg), q AS (SELECT doc_id, idx, t0, t1, unnest(ss) AS sentence, unnest(range(len(ss)))::BIGINT AS k FROM q0),
c AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY doc_id, idx ORDER BY k)::BIGINT AS upto, sum(length(sentence)) OVER (PARTITION BY doc_id, idx)::BIGINT AS total FROM q) SELECT doc_id, idx, k, t0 + (t1 - t0) * (upto - length(sentence)) // total AS s0, t0 + (t1 - t0) * upto // total AS s1 FROM c WHERE total > 0""")
def win_interpolate(spark, sf_dir):
    return sequences.interpolate(segments(spark, sf_dir))


@query("win_group_k", f"WITH {UTT}, n AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM utt) SELECT doc_id, (r - 1) // 3 AS section, min(idx) AS first, count(*) AS n FROM n GROUP BY doc_id, (r - 1) // 3")
def win_group_k(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))
    return utterances(spark, sf_dir).withColumn("section", F.floor((n - 1) / 3)).groupBy("doc_id", "section").agg(F.min("idx").alias("first"), F.count("*").alias("n"))


@query("win_systematic_sample", "WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM n WHERE (r - 1) % greatest(1, n // 16) = 0 AND (r - 1) // greatest(1, n // 16) < 16")
def win_systematic_sample(spark, sf_dir):
    return sequences.systematic_sample(table(spark, sf_dir, "documents"), "source", "doc_id", 16).select("source", "doc_id")


@query("win_dedupe_sentences", f"WITH {SEG}, q0 AS (SELECT doc_id, idx, string_split(regexp_replace(text || ' ' || text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM seg), q AS (SELECT doc_id, idx, unnest(ss) AS s, unnest(range(len(ss))) AS k FROM q0), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx, lower(s) ORDER BY k) AS r FROM q) SELECT doc_id, idx, string_agg(s, ' ' ORDER BY k) AS text FROM d WHERE r = 1 GROUP BY doc_id, idx")
def win_dedupe_sentences(spark, sf_dir):
    s = segments(spark, sf_dir).select("doc_id", "idx", F.posexplode(text.split_sentences(F.concat("text", F.lit(" "), "text"))).alias("k", "s"))
    first = s.groupBy("doc_id", "idx", F.lower("s").alias("low")).agg(F.min("k").alias("k"), F.min_by("s", "k").alias("s"))
    return first.groupBy("doc_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " ").alias("text"))


@query("fold_clean")
def fold_clean(spark, sf_dir):
    return sequences.clean(utterances(spark, sf_dir).select("doc_id", "idx", "speaker", "text", "t0", "t1"))


@query("fold_redundancy")
def fold_redundancy(spark, sf_dir):
    return sequences.drop_redundant(utterances(spark, sf_dir).select("doc_id", "idx", "text", "t0", "t1"))


@query("fold_overlap_merge")
def fold_overlap_merge(spark, sf_dir):
    s = segments(spark, sf_dir)
    w = W.partitionBy("doc_id").orderBy("idx")
    shown = s.select("doc_id", "idx", "t0", (F.col("t1") + 1_000).alias("t1"), F.concat_ws(" ", F.coalesce(F.lag(F.regexp_extract("text", r"(\S+)$", 1)).over(w), F.lit("")), "text").alias("text"), (-F.col("conf") / 100).alias("logprob"))
    return sequences.merge_overlaps(shown)


ASSIGN_SQL = f"""WITH RECURSIVE {SEG}, q AS (SELECT doc_id, idx, len(regexp_split_to_array(trim(text), '\\s+')) AS n, list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(regexp_split_to_array(trim(s), '\\s+'))) AS sizes FROM seg),
st(doc_id, idx, place, seen, used, got, n, sizes) AS (SELECT doc_id, idx, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, n, sizes FROM q
UNION ALL SELECT doc_id, idx, place + 1, seen + x, upto, upto - used, n, sizes FROM (SELECT *, CASE WHEN place + 1 = len(sizes) THEN n ELSE least(greatest((seen + x) * n // list_sum(sizes), used + 1), greatest(n - (len(sizes) - place - 1), used)) END::BIGINT AS upto FROM (SELECT *, sizes[place + 1] AS x FROM st WHERE place < len(sizes))))
SELECT doc_id, idx, (place - 1)::INT AS sentence, got::INT AS n_words FROM st WHERE place > 0"""


@query("fold_assign_words", ASSIGN_SQL)
def fold_assign_words(spark, sf_dir):
    w = segment_words(spark, sf_dir).groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("ws"))
    s = segments(spark, sf_dir).select("doc_id", "idx", text.split_sentences(F.col("text")).alias("sentences")).join(w, ["doc_id", "idx"])
    return sequences.assign_words(s)


@query("udf_dedupe_ngrams")
def udf_dedupe_ngrams(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", "idx", text_udf.dedupe_ngrams(F.concat_ws(" ", "speaker", "speaker", "text")).alias("text"))
