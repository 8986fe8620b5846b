"""Confidence, quality and n-gram statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalis.operators import lexicon, quality
from vocalis.operators.islands import previous
from vocalis.plans.registry import query
from vocalis.sources.adapters import LINES, SEG, SEGW, UTT, lines, segment_words, segments, table, utterances


@query("agg_conf_summary", f"WITH {SEG}, g AS (SELECT doc_id, count(*) AS n, sum(conf)::BIGINT AS s, list_sort(list(conf)) AS v FROM seg GROUP BY doc_id) SELECT doc_id, n, s / (n * 100) AS avg_conf, v[1] / 100 AS min_conf, v[n] / 100 AS max_conf, v[(n - 1) * 5 // 100 + 1] / 100 AS p05, v[(n - 1) * 95 // 100 + 1] / 100 AS p95 FROM g")
def agg_conf_summary(spark, sf_dir):
    return quality.confidence_summary(segments(spark, sf_dir))


@query("agg_doc_stats", f"WITH {SEG} SELECT doc_id, count(*) AS segments, sum(words)::BIGINT AS words, max(t1) / 1000 AS duration_s, count(DISTINCT speaker) AS speakers, sum(length(text))::BIGINT AS characters FROM seg GROUP BY doc_id")
def agg_doc_stats(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum("words").alias("words"), (F.max("t1") / 1000).alias("duration_s"), F.count_distinct("speaker").alias("speakers"), F.sum(F.length("text")).alias("characters"))


@query("agg_quality", f"WITH {SEG} SELECT doc_id, sum(CASE WHEN conf >= 60 THEN 1 ELSE 0 END) / count(*) AS share_ok, (max(t1) - min(t0)) / sum(t1 - t0) AS coverage, arg_min(idx, idx) AS first_chunk, arg_max(idx, idx) AS last_chunk, count(*) FILTER (WHERE conf < 45) AS low FROM seg GROUP BY doc_id")
def agg_quality(spark, sf_dir):
    g = segments(spark, sf_dir).groupBy("doc_id")
    return g.agg((F.count_if(F.col("conf") >= 60) / F.count("*")).alias("share_ok"), ((F.max("t1") - F.min("t0")) / F.sum(F.col("t1") - F.col("t0"))).alias("coverage"), F.min_by("idx", "idx").alias("first_chunk"), F.max_by("idx", "idx").alias("last_chunk"), F.count_if(F.col("conf") < 45).alias("low"))


CHUNK_METRICS = f"""{SEG}, c AS (SELECT *, idx // 5 AS chunk, ceil(words * 13 / 10.0)::BIGINT AS tokens, CASE WHEN lag(speaker) OVER (PARTITION BY doc_id, idx // 5 ORDER BY idx) <> speaker THEN 1 ELSE 0 END AS sw FROM seg),
sp AS (SELECT doc_id, chunk, speaker, count(*) AS k, min(idx) AS f FROM c GROUP BY doc_id, chunk, speaker), mj AS (SELECT doc_id, chunk, first(speaker ORDER BY k DESC, f) AS majority, string_agg(speaker || '=' || k::VARCHAR, ',' ORDER BY speaker) AS histogram FROM sp GROUP BY doc_id, chunk),
g AS (SELECT doc_id, chunk, sum(tokens)::BIGINT AS tokens, sum(sw)::BIGINT AS switches, sum(tokens * conf)::BIGINT AS ws, list_sort(list(conf)) AS v, count(*) AS n, count(*) FILTER (WHERE conf < 45) AS low FROM c GROUP BY doc_id, chunk)"""


@query("agg_chunk_metrics", f"WITH {CHUNK_METRICS} SELECT doc_id, chunk, tokens, switches, majority, histogram, ws / (tokens * 100) AS weighted_mean, v[n * 5 // 100 + 1] / 100 AS p05, low / n AS low_ratio FROM g JOIN mj USING (doc_id, chunk)")
def agg_chunk_metrics(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("chunk", F.floor(F.col("idx") / 5)).withColumn("tokens", F.ceil(F.col("words") * 13 / 10))
    return quality.chunk_metrics(s)


@query("agg_section_meta", f"WITH {SEG}, s AS (SELECT *, idx // 4 AS section FROM seg), h AS (SELECT doc_id, section, string_agg(speaker || '=' || k::VARCHAR, ',' ORDER BY speaker) AS histogram FROM (SELECT doc_id, section, speaker, count(*) AS k FROM s GROUP BY ALL) GROUP BY ALL), g AS (SELECT doc_id, section, count(*) AS n, sum(conf)::BIGINT AS s, list_sort(list(conf)) AS v FROM s GROUP BY ALL) SELECT doc_id, section, n AS sentence_count, s / (n * 100) AS avg_confidence, v[n * 5 // 100 + 1] / 100 AS confidence_p05, histogram FROM g JOIN h USING (doc_id, section)")
def agg_section_meta(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("section", F.floor(F.col("idx") / 4))
    g = s.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.sum("conf").alias("s"), F.array_sort(F.collect_list("conf")).alias("v"))
    n = F.col("n")
    out = g.join(quality.speaker_histogram(s, "section"), ["doc_id", "section"])
    return out.select("doc_id", "section", n.alias("sentence_count"), (F.col("s") / (n * 100)).alias("avg_confidence"), (quality.nth(F.col("v"), quality.floor_rank(n, 5)) / 100).alias("confidence_p05"), "histogram")


@query("agg_weighted_conf", f"WITH {SEG}, {SEGW}, d AS (SELECT doc_id, idx, CASE WHEN p % 7 = 0 THEN 300 ELSE greatest(10, p * 10) END AS dur, CASE WHEN p % 6 = 0 THEN 100 ELSE p END AS q FROM sw) SELECT doc_id, idx, sum(dur * q) / (sum(dur) * 100) AS mean, list_sort(list(q))[count(*) * 5 // 100 + 1] / 100 AS p05, sum(CASE WHEN q < 45 THEN dur ELSE 0 END) / 1000 AS low_s FROM d GROUP BY doc_id, idx")
def agg_weighted_conf(spark, sf_dir):
    w = segment_words(spark, sf_dir).withColumn("dur", F.when(F.col("p") % 7 == 0, 300).otherwise(F.greatest(F.lit(10), F.col("p") * 10))).withColumn("q", F.when(F.col("p") % 6 == 0, 100).otherwise(F.col("p")))
    arrays = w.groupBy("doc_id", "idx").agg(F.collect_list(F.struct("dur", "q")).alias("ws"))
    total = lambda f: F.aggregate("ws", F.lit(0).cast("long"), lambda s, x: s + f(x))
    rank = F.array_sort(F.transform("ws", lambda x: x["q"]))
    n = F.size("ws")
    return arrays.select("doc_id", "idx", (total(lambda x: x["dur"] * x["q"]) / (total(lambda x: x["dur"]) * 100)).alias("mean"), (F.element_at(rank, (F.floor(n * 5 / 100) + 1).cast("int")) / 100).alias("p05"), (total(lambda x: F.when(x["q"] < 45, x["dur"]).otherwise(0)) / 1000).alias("low_s"))


@query("agg_run_metrics", f"WITH {SEG} SELECT count(*) AS segments, count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE conf < 45) AS low, sum(words)::BIGINT AS words, sum(conf) / (count(*) * 100) AS mean FROM seg")
def agg_run_metrics(spark, sf_dir):
    return segments(spark, sf_dir).agg(F.count("*").alias("segments"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("conf") < 45).alias("low"), F.sum("words").alias("words"), (F.sum("conf") / (F.count("*") * 100)).alias("mean"))


@query("agg_mode_lang", "SELECT source, first(lang ORDER BY n DESC, f) AS lang FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) GROUP BY source")
def agg_mode_lang(spark, sf_dir):
    g = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    return g.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("f"))).alias("lang"))


TOKENS_SQL = "tk AS (SELECT conv_id AS doc_id, turn AS idx, regexp_extract_all(text, '[a-zA-ZÀ-ÖØ-öø-ÿ0-9]+') AS ws FROM conversations)"
NGRAMS = f"{TOKENS_SQL}, ng AS (SELECT doc_id, idx, n, array_to_string(ws[i:i + n - 1], ' ') AS form FROM (SELECT doc_id, idx, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM tk, (VALUES (1), (2), (3)) t(n) WHERE len(ws) >= n))"


@query("agg_ngrams", f"WITH {NGRAMS} SELECT n, lower(form) AS key, count(*) AS cnt, count(DISTINCT form) AS forms, min(form) AS first_form FROM ng GROUP BY n, lower(form) HAVING count(*) >= 3")
def agg_ngrams(spark, sf_dir):
    g = lexicon.ngrams(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text"))
    return lexicon.statistics(g, 3)


@query("topk_ngrams", f"WITH {NGRAMS} SELECT n, lower(form) AS key, count(*) AS cnt FROM ng GROUP BY n, lower(form) ORDER BY cnt DESC, key, n LIMIT 50")
def topk_ngrams(spark, sf_dir):
    g = lexicon.ngrams(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text"))
    return g.groupBy("n", "key").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "key", "n").limit(50)


@query("filt_candidates", f"WITH {NGRAMS}, k AS (SELECT n, lower(form) AS key, count(*) AS cnt FROM ng GROUP BY n, lower(form)) SELECT n, key, cnt FROM k WHERE length(regexp_replace(key, '[^a-zà-öø-ÿ]', '', 'g')) >= 4 AND key NOT IN ('dans', 'avec', 'pour', 'from', 'that', 'this', 'with') AND cnt >= 2")
def filt_candidates(spark, sf_dir):
    g = lexicon.ngrams(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text"))
    return lexicon.candidates(g.groupBy("n", "key").agg(F.count("*").alias("cnt"))).where("cnt >= 2")


@query("topk_mojibake")
def topk_mojibake(spark, sf_dir):
    rows = spark.createDataFrame([(1, 0, "dÃ©jÃ  vu et dÃ©jÃ"), (1, 1, "déjà vu")], "doc_id bigint, idx bigint, text string")
    return lexicon.mojibake_rules(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text").unionByName(rows))


@query("agg_section_chunks", f"WITH {SEG} SELECT doc_id, idx // 4 AS section, string_agg(DISTINCT (idx // 3)::VARCHAR, ',' ORDER BY (idx // 3)::VARCHAR) AS chunks FROM seg GROUP BY doc_id, idx // 4")
def agg_section_chunks(spark, sf_dir):
    chunks = segments(spark, sf_dir).groupBy("doc_id", F.floor(F.col("idx") / 3).cast("string").alias("chunk")).agg(F.collect_set(F.floor(F.col("idx") / 4)).alias("sections"))
    return chunks.select("doc_id", "chunk", F.explode("sections").alias("section")).groupBy("doc_id", "section").agg(F.array_join(F.array_sort(F.collect_list("chunk")), ",").alias("chunks"))


@query("agg_clean_report", f"WITH {LINES}, x AS (SELECT source, trim(line) = '' AS blank, regexp_matches(line, '\\d') AS digits, length(line) > 500 AS long, line, doc_id, pos FROM ln) SELECT source, count(*) AS lines, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE digits) AS digits, count(*) FILTER (WHERE long) AS long FROM x GROUP BY source")
def agg_clean_report(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("source").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") == "").alias("blank"), F.count_if(F.col("line").rlike(r"\d")).alias("digits"), F.count_if(F.length("line") > 500).alias("long"))


@query("agg_qa", "SELECT lang, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '[,;]{2,}')) AS doubled_marks, count(*) FILTER (WHERE regexp_matches(text, '  ')) AS double_spaces, count(*) FILTER (WHERE NOT regexp_matches(trim(text), '[.!?]$')) AS open_end FROM documents GROUP BY lang")
def agg_qa(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(t.rlike("[,;]{2,}")).alias("doubled_marks"), F.count_if(t.rlike("  ")).alias("double_spaces"), F.count_if(~F.trim(t).rlike(r"[.!?]\z")).alias("open_end"))


@query("val_coverage", f"WITH {UTT}, g AS (SELECT doc_id, sum(t1 - t0)::BIGINT AS spoken, max(t1) AS total FROM utt GROUP BY doc_id) SELECT doc_id, spoken / total AS coverage, spoken * 100 < total * 95 AS below FROM g")
def val_coverage(spark, sf_dir):
    g = utterances(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("t1") - F.col("t0")).alias("spoken"), F.max("t1").alias("total"))
    return g.select("doc_id", (F.col("spoken") / F.col("total")).alias("coverage"), (F.col("spoken") * 100 < F.col("total") * 95).alias("below"))


@query("agg_clusters", f"WITH {SEG}, {SEGW}, low AS (SELECT *, CASE WHEN w0 - lag(w1) OVER (PARTITION BY doc_id, idx ORDER BY w0) <= 200 THEN 0 ELSE 1 END AS fresh FROM sw WHERE p < 55), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, idx ORDER BY w0) AS isl FROM low) SELECT doc_id, idx, min(w0) AS w0, max(w1) AS w1, count(*) AS n, sum(p) / (count(*) * 100) AS mean FROM i GROUP BY doc_id, idx, isl HAVING count(*) >= 3")
def agg_clusters(spark, sf_dir):
    c = quality.clusters(segment_words(spark, sf_dir), 55)
    return c.select("doc_id", "idx", "w0", "w1", "n", (F.col("p") / (F.col("n") * 100)).alias("mean"))


@query("agg_sparkline", f"WITH {SEG}, s AS (SELECT doc_id, idx // 2 AS section, CASE WHEN min(conf) >= 5 THEN sum(conf) * 7 // (count(*) * 100) END AS level FROM seg GROUP BY doc_id, idx // 2) SELECT doc_id, string_agg(CASE WHEN level IS NULL THEN '.' ELSE substr('12345678', level::INT + 1, 1) END, '' ORDER BY section) AS sparkline FROM s GROUP BY doc_id")
def agg_sparkline(spark, sf_dir):
    g = segments(spark, sf_dir).groupBy("doc_id", F.floor(F.col("idx") / 2).alias("section")).agg(F.when(F.min("conf") >= 5, F.floor(F.sum("conf") * 7 / (F.count("*") * 100))).alias("level"))
    return quality.sparkline(g, "12345678")


@query("agg_norm_stats", f"WITH {LINES}, x AS (SELECT doc_id, line, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS clean FROM ln) SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE clean <> line AND clean <> '') AS modified, count(*) FILTER (WHERE clean = '') AS dropped FROM x GROUP BY doc_id")
def agg_norm_stats(spark, sf_dir):
    clean = F.trim(F.regexp_replace("line", r"[ \t]+", " "))
    x = lines(spark, sf_dir).select("doc_id", "line", clean.alias("clean"))
    return x.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if((F.col("clean") != F.col("line")) & (F.col("clean") != "")).alias("modified"), F.count_if(F.col("clean") == "").alias("dropped"))


@query("agg_window_logprob", f"WITH {SEG} SELECT doc_id, t0 // 75000 AS win, sum(CASE WHEN conf % 4 <> 0 THEN -conf END) / count(CASE WHEN conf % 4 <> 0 THEN 1 END) / 100 AS avg_logprob, count(*) AS n FROM seg GROUP BY doc_id, t0 // 75000")
def agg_window_logprob(spark, sf_dir):
    known = F.when(F.col("conf") % 4 != 0, -F.col("conf"))
    g = segments(spark, sf_dir).groupBy("doc_id", F.floor(F.col("t0") / 75_000).alias("win")).agg(F.sum(known).alias("s"), F.count(known).alias("k"), F.count("*").alias("n"))
    return g.select("doc_id", "win", (F.try_divide("s", "k") / 100).alias("avg_logprob"), "n")


@query("win_switches", f"WITH {UTT}, x AS (SELECT doc_id, CASE WHEN lag(speaker) OVER (PARTITION BY doc_id ORDER BY idx) <> speaker THEN 1 ELSE 0 END AS sw FROM utt) SELECT doc_id, sum(sw)::BIGINT AS switches FROM x GROUP BY doc_id")
def win_switches(spark, sf_dir):
    u = utterances(spark, sf_dir).withColumn("sw", F.when(previous("speaker") != F.col("speaker"), 1).otherwise(0))
    return u.groupBy("doc_id").agg(F.sum("sw").alias("switches"))
