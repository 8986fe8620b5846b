"""Projections, filters, predicates and validators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalis.operators import control, quality
from vocalis.plans.registry import query
from vocalis.sources.adapters import JOBS, LINES, SEG, SEGW, UTT, jobs, lines, segment_words, segments, table, utterances


def with_words(spark, sf_dir):
    """Segments with their words as an ordered array of structs."""
    w = segment_words(spark, sf_dir).groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct("k", "word", "w0", "w1", "p"))).alias("ws"))
    return segments(spark, sf_dir).join(w, ["doc_id", "idx"])


@query("proj_segment_confidence", f"WITH {SEG}, {SEGW}, m AS (SELECT doc_id, idx, sum(p) AS s, count(*) AS n FROM sw WHERE p % 4 <> 0 GROUP BY doc_id, idx) SELECT doc_id, idx, coalesce(CASE WHEN idx % 2 = 0 THEN conf / 100 END, s / (n * 100)) AS confidence FROM seg LEFT JOIN m USING (doc_id, idx)")
def proj_segment_confidence(spark, sf_dir):
    s = with_words(spark, sf_dir).withColumn("given", F.when(F.col("idx") % 2 == 0, F.col("conf") / 100))
    scored = F.filter("ws", lambda w: w["p"] % 4 != 0)
    return s.select("doc_id", "idx", F.coalesce("given", quality.mean_hundredths(scored)).alias("confidence"))


@query("proj_clean_confidence", f"WITH {SEG}, {SEGW}, m AS (SELECT doc_id, idx, sum(p) AS s, count(*) AS n FROM sw WHERE p % 3 = 0 GROUP BY doc_id, idx) SELECT doc_id, idx, coalesce(CASE WHEN idx % 3 = 0 THEN s / (n * 100) END, CASE WHEN idx % 3 = 1 THEN conf / 100 END, greatest(0.0, least(1.0, ((idx - 6) * 2 + 5) / 5.0))) AS confidence FROM seg LEFT JOIN m USING (doc_id, idx)")
def proj_clean_confidence(spark, sf_dir):
    s = with_words(spark, sf_dir)
    known = F.filter("ws", lambda w: (w["p"] % 3 == 0) & (F.col("idx") % 3 == 0))
    logprob = ((F.col("idx") - 6) * 2).cast("double")
    return s.select("doc_id", "idx", F.coalesce(quality.mean_hundredths(known), F.when(F.col("idx") % 3 == 1, F.col("conf") / 100), quality.logprob_confidence(logprob)).alias("confidence"))


@query("proj_ms_to_s", f"WITH {SEG} SELECT doc_id, idx, t0 / 1000 AS start_s, t1 / 1000 AS end_s, text FROM seg WHERE text <> ''")
def proj_ms_to_s(spark, sf_dir):
    return segments(spark, sf_dir).where("text <> ''").select("doc_id", "idx", (F.col("t0") / 1000).alias("start_s"), (F.col("t1") / 1000).alias("end_s"), "text")


@query("filt_words", f"WITH {SEG}, {SEGW} SELECT doc_id, idx, string_agg(word, ' ' ORDER BY k) AS kept FROM sw WHERE p % 5 = 0 OR p >= 40 GROUP BY doc_id, idx")
def filt_words(spark, sf_dir):
    probability = lambda w: F.when(w["p"] % 5 == 0, F.lit("?")).otherwise(w["p"].cast("string")).try_cast("double")
    kept = F.filter("ws", lambda w: F.coalesce(probability(w) >= 40, F.lit(True)))
    return with_words(spark, sf_dir).where(F.size(kept) > 0).select("doc_id", "idx", F.array_join(F.transform(kept, lambda w: w["word"]), " ").alias("kept"))


@query("filt_low_words_topn", f"WITH {SEG}, {SEGW} SELECT doc_id, idx, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE r <= 3), '') AS low FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY p >= 20, k) AS r FROM sw) WHERE p < 20 GROUP BY doc_id, idx")
def filt_low_words_topn(spark, sf_dir):
    low = F.slice(F.filter("ws", lambda w: w["p"] < 20), 1, 3)
    return with_words(spark, sf_dir).where(F.size(low) > 0).select("doc_id", "idx", F.array_join(F.transform(low, lambda w: w["word"]), " ").alias("low"))


@query("filt_refine_targets", f"WITH {SEG}, {SEGW} SELECT doc_id, idx, count(*) FILTER (WHERE p < 30) AS low, count(*) AS n FROM sw JOIN seg USING (doc_id, idx) WHERE t1 - t0 > 0 AND t1 - t0 <= 30000 GROUP BY doc_id, idx HAVING count(*) FILTER (WHERE p < 30) * 10 >= count(*) * 3")
def filt_refine_targets(spark, sf_dir):
    s = with_words(spark, sf_dir).where("t1 - t0 > 0 AND t1 - t0 <= 30000")
    s = s.select("doc_id", "idx", F.size(F.filter("ws", lambda w: w["p"] < 30)).cast("long").alias("low"), F.size("ws").cast("long").alias("n"))
    return s.where("low * 10 >= n * 3")


@query("filt_time_tolerance", f"WITH {SEG}, {SEGW} SELECT doc_id, idx, k, word, w0 - 1000 AS w0, w1 - 1000 AS w1 FROM sw WHERE w1 >= 5000 - 50 AND w0 <= 20000 + 50")
def filt_time_tolerance(spark, sf_dir):
    return segment_words(spark, sf_dir).where((F.col("w1") >= 5000 - 50) & (F.col("w0") <= 20000 + 50)).select("doc_id", "idx", "k", "word", (F.col("w0") - 1000).alias("w0"), (F.col("w1") - 1000).alias("w1"))


@query("filt_low_conf_rows", f"WITH {SEG}, {SEGW} SELECT doc_id, idx, k, coalesce(nullif(trim(word), ''), '?') AS word, w0, w1, p / 100 AS score FROM sw WHERE p < 35")
def filt_low_conf_rows(spark, sf_dir):
    exploded = with_words(spark, sf_dir).select("doc_id", "idx", F.explode("ws").alias("w")).where("w.p < 35")
    return exploded.select("doc_id", "idx", "w.k", F.coalesce(F.nullif(F.trim("w.word"), F.lit("")), F.lit("?")).alias("word"), "w.w0", "w.w1", (F.col("w.p") / 100).alias("score"))


@query("filt_drop_or_flag", f"WITH {SEG} SELECT doc_id, idx, CASE WHEN conf < 50 THEN 'low_confidence' ELSE '' END AS flags FROM seg WHERE conf >= 20 AND trim(text) <> ''")
def filt_drop_or_flag(spark, sf_dir):
    s = segments(spark, sf_dir).where((F.col("conf") >= 20) & (F.trim("text") != ""))
    flags = F.when(F.col("conf") < 50, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))
    return s.select("doc_id", "idx", F.array_join(flags, ",").alias("flags"))


SPANS = f"""{SEG}, st AS (SELECT doc_id, idx, conf, (conf * 7 + idx) % 100 AS p05 FROM seg),
spans AS (SELECT doc_id, idx, 'sentence' AS source, CASE WHEN conf < 30 THEN 'low_mean' ELSE 'p05_drop' END AS reason, conf / 100 AS score, p05 / 100 AS p05 FROM st WHERE conf < 30 OR p05 < 10
UNION ALL SELECT doc_id, min(idx), 'chunk', 'low_span', sum(conf) / (count(*) * 100), min(p05) / 100 FROM st GROUP BY doc_id, idx // 4 HAVING sum(CASE WHEN conf < 30 THEN 1 ELSE 0 END) * 4 >= count(*))"""


@query("filt_low_conf_spans", f"WITH {SPANS} SELECT * FROM spans")
def filt_low_conf_spans(spark, sf_dir):
    return quality.review_queue(segments(spark, sf_dir).select("doc_id", "idx", "conf", ((F.col("conf") * 7 + F.col("idx")) % 100).alias("p05")))


@query("sort_review_queue", f"WITH {SPANS} SELECT row_number() OVER (ORDER BY coalesce(nullif(score, 0), 1.0), coalesce(nullif(p05, 0), 1.0), doc_id, idx, source) AS place, doc_id, idx, source FROM spans")
def sort_review_queue(spark, sf_dir):
    q = filt_low_conf_spans(spark, sf_dir)
    order = [F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0)) for c in ("score", "p05")]
    return q.select(F.row_number().over(W.orderBy(*order, "doc_id", "idx", "source")).cast("long").alias("place"), "doc_id", "idx", "source")


@query("proj_clean_entry", f"WITH {SEG} SELECT '1.0.0' AS schema_version, doc_id::VARCHAR || '-' || idx::VARCHAR AS id, 'conversations' AS source, 'sentence' AS unit, text AS text_human, lower(text) AS text_machine, ceil(words * 1.3)::BIGINT AS tokens FROM seg")
def proj_clean_entry(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.select(F.lit("1.0.0").alias("schema_version"), F.concat_ws("-", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("id"), F.lit("conversations").alias("source"), F.lit("sentence").alias("unit"), F.col("text").alias("text_human"), F.lower("text").alias("text_machine"), F.ceil(F.col("words") * 1.3).alias("tokens"))


@query("proj_citation", f"WITH {SEG} SELECT doc_id, idx, '[' || doc_id::VARCHAR || ' ' || lpad((t0 // 60000)::VARCHAR, 2, '0') || ':' || lpad((t0 // 1000 % 60)::VARCHAR, 2, '0') || ' {{page}}]' AS citation FROM seg".replace("{{", "{").replace("}}", "}"))
def proj_citation(spark, sf_dir):
    from vocalis.functions.text import template
    from vocalis.sources.formats import minutes

    return segments(spark, sf_dir).select("doc_id", "idx", template("[{doc} {start} {page}]", {"doc": F.col("doc_id").cast("string"), "start": minutes(F.col("t0"))}).alias("citation"))


SPLIT = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("proj_quotes", f"WITH {SEG}, s AS (SELECT doc_id, idx, unnest({SPLIT.format('text')}) AS q, unnest(range(len({SPLIT.format('text')}))) AS k FROM seg), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY k) AS n FROM s WHERE length(q) BETWEEN 30 AND 180) SELECT doc_id, idx, n::BIGINT AS ordinal, q AS quote FROM f WHERE n <= 3")
def proj_quotes(spark, sf_dir):
    from vocalis.functions.text import split_sentences

    q = F.slice(F.filter(split_sentences(F.col("text")), lambda x: F.length(x).between(30, 180)), 1, 3)
    return segments(spark, sf_dir).select("doc_id", "idx", F.posexplode(q).alias("ordinal", "quote")).withColumn("ordinal", (F.col("ordinal") + 1).cast("long"))


@query("topn_quotes", f"WITH {SEG}, s AS (SELECT doc_id, idx, unnest({SPLIT.format('text')}) AS q, unnest(range(len({SPLIT.format('text')}))) AS k FROM seg), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) AS n FROM s WHERE length(q) BETWEEN 30 AND 180) SELECT doc_id, string_agg(q, ' | ' ORDER BY n) AS quotes FROM f WHERE n <= 3 GROUP BY doc_id")
def topn_quotes(spark, sf_dir):
    from vocalis.functions.text import split_sentences

    s = segments(spark, sf_dir).select("doc_id", "idx", F.posexplode(split_sentences(F.col("text"))).alias("k", "q")).where(F.length("q").between(30, 180))
    first = s.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("idx", "k"))).where("n <= 3")
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "q"))), lambda x: x["q"]), " | ").alias("quotes"))


@query("pred_mojibake", "SELECT conv_id AS doc_id, turn AS idx, regexp_matches(text, 'Ã|Â|â€|�') AS broken, regexp_matches(replace(replace(text, 'é', 'Ã©'), '.', 'â€'), 'Ã|Â|â€|�') AS broken_after FROM conversations")
def pred_mojibake(spark, sf_dir):
    """Every text as it is, and as it would be after a wrong decoding of an accent and a mark."""
    from vocalis.functions.text import has_mojibake

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")
    damaged = F.replace(F.replace("text", F.lit("é"), F.lit("Ã©")), F.lit("."), F.lit("â€"))
    return c.select("doc_id", "idx", has_mojibake(F.col("text")).alias("broken"), has_mojibake(damaged).alias("broken_after"))


@query("pred_doc_state", """SELECT doc_id, CASE WHEN NOT work THEN 'missing' WHEN NOT clean THEN 'transcribed' WHEN NOT rules THEN 'cleaned' WHEN NOT export THEN 'validated' ELSE 'exported' END AS state,
CASE WHEN locked OR NOT work THEN '' WHEN NOT clean THEN 'clean' WHEN NOT rules THEN 'scan,apply' WHEN NOT export THEN 'export' ELSE 'export,check,query' END AS actions
FROM (SELECT doc_id, doc_id % 11 <> 0 AS work, doc_id % 7 <> 0 AS clean, doc_id % 5 <> 0 AS rules, doc_id % 3 <> 0 AS export, doc_id % 13 = 0 AS locked FROM documents)""")
def pred_doc_state(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", *[(F.col("doc_id") % n != 0).alias(c) for n, c in ((11, "work"), (7, "clean"), (5, "rules"), (3, "export"))], (F.col("doc_id") % 13 == 0).alias("locked"))
    return d.select("doc_id", control.document_state().alias("state"), control.allowed_actions().alias("actions"))


@query("pred_failure_class", """SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN 'cancelled' WHEN contains(l, 'out of memory') THEN 'oom' WHEN contains(l, 'no space') THEN 'disk_full' WHEN contains(l, 'permission denied') THEN 'permission' WHEN contains(l, 'not found') THEN 'missing_input' ELSE 'unknown' END AS failure
FROM (SELECT event_id, lower(CASE event_id % 6 WHEN 0 THEN 'CUDA out of memory' WHEN 1 THEN 'No space left, file not found' WHEN 2 THEN 'Permission denied' WHEN 3 THEN 'File not found' ELSE event_type END) AS l FROM events)""")
def pred_failure_class(spark, sf_dir):
    text = F.when(F.col("event_id") % 6 == 0, "CUDA out of memory").when(F.col("event_id") % 6 == 1, "No space left, file not found").when(F.col("event_id") % 6 == 2, "Permission denied").when(F.col("event_id") % 6 == 3, "File not found").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("log"), (F.col("event_id") % 17 == 0).alias("cancelled"))
    return e.select("id", control.failure_class(F.col("log"), F.col("cancelled")).alias("failure"))


@query("pred_keyword_first", f"WITH {LINES} SELECT doc_id, pos, CASE WHEN contains(l, 'therethe') THEN 'therethe' WHEN contains(l, 'ention') THEN 'ention' WHEN contains(l, 'the') THEN 'the' END AS keyword FROM (SELECT doc_id, pos, lower(line) AS l FROM ln) WHERE contains(l, 'therethe') OR contains(l, 'ention') OR contains(l, 'the')")
def pred_keyword_first(spark, sf_dir):
    found = lines(spark, sf_dir).select("doc_id", "pos", control.first_keyword(F.lower("line"), ["the", "ention", "therethe"]).alias("keyword"))
    return found.where("keyword IS NOT NULL")


@query("jobs_filter", f"WITH {JOBS} SELECT id, doc, action, status FROM jobs WHERE contains(lower(action), 'er') AND contains(lower(doc::VARCHAR), '1')")
def jobs_filter(spark, sf_dir):
    return control.search(jobs(spark, sf_dir), doc="1", action="ER").select("id", "doc", "action", "status")


@query("filt_review_rows", f"WITH {SEG}, r AS (SELECT doc_id, idx, conf, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS before, lead(text) OVER (PARTITION BY doc_id ORDER BY idx) AS after FROM seg) SELECT doc_id, idx, conf / 100 AS score, before, after FROM r WHERE conf < 25")
def filt_review_rows(spark, sf_dir):
    w = W.partitionBy("doc_id").orderBy("idx")
    s = segments(spark, sf_dir).select("doc_id", "idx", "conf", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))
    return s.where("conf < 25").select("doc_id", "idx", (F.col("conf") / 100).alias("score"), "before", "after")


@query("val_missing_confidence", f"WITH {SEG} SELECT doc_id, idx, words FROM seg WHERE words > 0 AND (CASE WHEN conf % 9 <> 0 THEN conf END) IS NULL")
def val_missing_confidence(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("confidence", F.when(F.col("conf") % 9 != 0, F.col("conf")))
    return s.where("words > 0 AND confidence IS NULL").select("doc_id", "idx", "words")


@query("proj_flatten_sentences", f"WITH {SEG}, s AS (SELECT doc_id, idx // 4 AS section, idx, unnest({SPLIT.format('text')}) AS sentence, unnest(range(len({SPLIT.format('text')})))::BIGINT AS k FROM seg) SELECT doc_id, section, idx, k, sentence FROM s")
def proj_flatten_sentences(spark, sf_dir):
    from vocalis.functions.text import split_sentences

    nested = segments(spark, sf_dir).withColumn("section", F.floor(F.col("idx") / 4)).groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("idx", split_sentences(F.col("text")).alias("sentences")))).alias("paragraphs"))
    flat = nested.select("doc_id", "section", F.explode("paragraphs").alias("p")).select("doc_id", "section", "p.idx", F.posexplode("p.sentences").alias("k", "sentence"))
    return flat.withColumn("k", F.col("k").cast("long"))


@query("val_pending_rules", "SELECT DISTINCT doc_id FROM documents d WHERE lang = 'fr' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def val_pending_rules(spark, sf_dir):
    suggested = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id").distinct()
    return suggested.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("join_coalesce_patch", f"WITH {SEG}, n AS (SELECT doc_id, idx, replace(text, ' ', '_') AS text FROM seg WHERE conf < 30) SELECT seg.doc_id, seg.idx, coalesce(n.text, seg.text) AS text, n.text IS NOT NULL AS refined FROM seg LEFT JOIN n USING (doc_id, idx)")
def join_coalesce_patch(spark, sf_dir):
    s = segments(spark, sf_dir)
    refined = s.where("conf < 30").select("doc_id", "idx", F.translate("text", " ", "_").alias("new"))
    return s.join(refined, ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("new", "text").alias("text"), F.col("new").isNotNull().alias("refined"))


@query("win_word_runs", f"WITH {UTT} SELECT doc_id, count(*) AS rows, sum(words)::BIGINT AS words FROM utt GROUP BY doc_id")
def win_word_runs(spark, sf_dir):
    return utterances(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum("words").alias("words"))
