"""Interval joins, lookups, integrity checks and fuzzy joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalis.functions import text_udf
from vocalis.operators import fuzzy, intervals
from vocalis.plans.registry import query
from vocalis.sources.adapters import JOBS, SEG, SEGW, TURNS, UTT, jobs, row_id, segment_words, segments, table, turns, utterances

CHUNKS = SEG + ", ck AS (SELECT doc_id, idx // 3 AS chunk, min(t0) + 100 AS c0, max(t1) - 100 AS c1 FROM seg GROUP BY doc_id, idx // 3)"


def chunks(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("doc_id", F.floor(F.col("idx") / 3).alias("chunk")).agg((F.min("t0") + 100).alias("c0"), (F.max("t1") - 100).alias("c1"))


@query("join_interval_overlap", f"WITH {CHUNKS} SELECT ck.doc_id, chunk, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS segment_ids FROM ck JOIN seg ON ck.doc_id = seg.doc_id AND t1 > c0 AND t0 < c1 GROUP BY ck.doc_id, chunk")
def join_interval_overlap(spark, sf_dir):
    pairs = intervals.overlap(chunks(spark, sf_dir), segments(spark, sf_dir).select("doc_id", "idx", "t0", "t1"), ("c0", "c1"), ("t0", "t1"))
    return pairs.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda x: x.cast("string")), ",").alias("segment_ids"))


@query("join_speaker_midpoint", f"WITH {TURNS}, l AS (SELECT doc_id, arg_max(speaker, turn) AS last FROM turns GROUP BY doc_id), h AS (SELECT u.doc_id, u.idx, arg_min(t.speaker, turn) AS who FROM utt u JOIN turns t ON u.doc_id = t.doc_id AND (t0 + t1) // 2 BETWEEN s0 AND s1 GROUP BY u.doc_id, u.idx) SELECT u.doc_id, u.idx, coalesce(who, last) AS speaker FROM utt u LEFT JOIN h USING (doc_id, idx) LEFT JOIN l USING (doc_id)")
def join_speaker_midpoint(spark, sf_dir):
    u = utterances(spark, sf_dir).select("doc_id", "idx", "t0", "t1")
    return intervals.at_point(u, turns(spark, sf_dir), F.floor((F.col("t0") + F.col("t1")) / 2), ("s0", "s1"), "turn", "speaker", ("doc_id", "idx")).select("doc_id", "idx", "speaker")


for _name, _margin in (("join_speech_semi", 50), ("join_speech_mask", 300)):

    @query(_name, f"WITH {TURNS}, sp AS (SELECT doc_id, s0 + 800 AS s0, s1 - 800 AS s1 FROM turns WHERE s1 - s0 > 2000), i AS (SELECT doc_id, idx FROM utt u WHERE EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = u.doc_id AND (t0 + t1) // 2 >= s0 - {_margin} AND (t0 + t1) // 2 <= s1 + {_margin})) SELECT * FROM i UNION ALL SELECT doc_id, idx FROM utt WHERE doc_id NOT IN (SELECT doc_id FROM i)")
    def speech(spark, sf_dir, margin=_margin):
        spoken = turns(spark, sf_dir).where("s1 - s0 > 2000").select("doc_id", (F.col("s0") + 800).alias("s0"), (F.col("s1") - 800).alias("s1"))
        u = utterances(spark, sf_dir).select("doc_id", "idx", "t0", "t1")
        return intervals.near_speech(u, spoken, F.floor((F.col("t0") + F.col("t1")) / 2), margin, ("doc_id", "idx")).select("doc_id", "idx")


@query("join_containment_first", f"WITH {CHUNKS}, h AS (SELECT s.doc_id, s.idx, min(chunk) AS c FROM seg s JOIN ck ON s.doc_id = ck.doc_id AND t0 >= c0 - 100 AND t1 <= c1 + 100 GROUP BY s.doc_id, s.idx), l AS (SELECT doc_id, max(chunk) AS last FROM ck GROUP BY doc_id) SELECT s.doc_id, s.idx, coalesce(c, last) AS chunk FROM seg s LEFT JOIN h USING (doc_id, idx) LEFT JOIN l USING (doc_id)")
def join_containment_first(spark, sf_dir):
    s, c = segments(spark, sf_dir).select("doc_id", "idx", "t0", "t1"), chunks(spark, sf_dir)
    near = intervals.overlap(s, c.select("doc_id", "chunk", "c0", "c1"), ("t0", "t1"), ("c0", "c1"), 101)
    hit = near.where((F.col("t0") >= F.col("c0") - 100) & (F.col("t1") <= F.col("c1") + 100)).groupBy("doc_id", "idx").agg(F.min("chunk").alias("c"))
    last = c.groupBy("doc_id").agg(F.max("chunk").alias("last"))
    return s.join(hit, ["doc_id", "idx"], "left").join(last, "doc_id", "left").select("doc_id", "idx", F.coalesce("c", "last").alias("chunk"))


INTERVAL = f"{SEG}, {SEGW}, wi AS (SELECT s.doc_id, s.idx, list_sort(list(p)) AS v, count(*) AS n, sum(p)::BIGINT AS s, count(*) FILTER (WHERE p < 35) AS low FROM seg s JOIN sw ON s.doc_id = sw.doc_id AND w1 > t0 + 300 AND w0 < t1 + 500 GROUP BY s.doc_id, s.idx)"


@query("join_word_interval", f"WITH {INTERVAL} SELECT doc_id, idx, n, s AS total FROM wi")
def join_word_interval(spark, sf_dir):
    return interval_words(spark, sf_dir).groupBy("doc_id", "idx").agg(F.count("*").alias("n"), F.sum("p").alias("total"))


def interval_words(spark, sf_dir):
    """Words of any segment that touch a segment's span, shifted by half a second."""
    spans = segments(spark, sf_dir).select("doc_id", "idx", (F.col("t0") + 300).alias("a"), (F.col("t1") + 500).alias("b"))
    return intervals.overlap(spans, segment_words(spark, sf_dir).select("doc_id", "p", "w0", "w1"), ("a", "b"), ("w0", "w1"))


@query("agg_interval_conf", f"WITH {INTERVAL} SELECT doc_id, idx, s / (n * 100) AS mean, v[greatest(0, n * 5 // 100 - 1) + 1] / 100 AS p05, low / n AS low_ratio FROM wi")
def agg_interval_conf(spark, sf_dir):
    g = interval_words(spark, sf_dir).groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list("p")).alias("v"), F.count("*").alias("n"), F.sum("p").alias("s"), F.count_if(F.col("p") < 35).alias("low"))
    at = F.greatest(F.lit(0), F.floor(F.col("n") * 5 / 100) - 1) + 1
    return g.select("doc_id", "idx", (F.col("s") / (F.col("n") * 100)).alias("mean"), (F.element_at("v", at.cast("int")) / 100).alias("p05"), (F.col("low") / F.col("n")).alias("low_ratio"))


@query("join_hits_lookup", f"WITH {SEG}, h AS (SELECT doc_id::VARCHAR || '-' || idx::VARCHAR AS chunk_id FROM seg UNION ALL SELECT 'none') SELECT h.chunk_id, doc_id, t0 / 1000 AS start_s, text FROM h LEFT JOIN seg ON h.chunk_id = doc_id::VARCHAR || '-' || idx::VARCHAR")
def join_hits_lookup(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("chunk_id", row_id(F.col("doc_id"), F.col("idx")))
    hits = s.select("chunk_id").unionByName(spark.createDataFrame([("none",)], "chunk_id string"))
    return hits.join(s, "chunk_id", "left").select("chunk_id", "doc_id", (F.col("t0") / 1000).alias("start_s"), "text")


@query("join_section_titles", f"WITH {SEG}, t AS (SELECT doc_id, idx // 2 AS section, 'T' || (idx // 2)::VARCHAR || '-' || arg_min(speaker, idx) AS title FROM seg GROUP BY doc_id, idx // 2) SELECT s.doc_id, s.idx // 3 AS chunk, string_agg(DISTINCT title, ',' ORDER BY title) AS titles FROM seg s LEFT JOIN t ON s.doc_id = t.doc_id AND s.idx // 2 = t.section GROUP BY s.doc_id, s.idx // 3")
def join_section_titles(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("section", F.floor(F.col("idx") / 2))
    first = s.groupBy("doc_id", "section").agg(F.min_by("speaker", "idx").alias("speaker"))
    titles = first.select("doc_id", "section", F.concat(F.lit("T"), F.col("section").cast("string"), F.lit("-"), "speaker").alias("title"))
    return s.join(titles, ["doc_id", "section"], "left").groupBy("doc_id", F.floor(F.col("idx") / 3).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_set("title")), ",").alias("titles"))


MANIFEST = f"{SEG}, mf AS (SELECT doc_id, idx, t0, t1 FROM seg), rs AS (SELECT doc_id, idx, text FROM seg)"


@query("join_manifest", f"WITH {MANIFEST} SELECT mf.doc_id, mf.idx, t0, t1, text FROM mf JOIN rs USING (doc_id, idx)")
def join_manifest(spark, sf_dir):
    s = segments(spark, sf_dir)
    return intervals_total(s.select("doc_id", "idx", "t0", "t1"), s.select("doc_id", "idx", "text"))


def intervals_total(manifest, results):
    """Every window of the manifest with its result; a missing result raises when the row is read."""
    joined = manifest.join(results.withColumn("__found", F.lit(True)), ["doc_id", "idx"], "left")
    text = F.when(F.col("__found"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no result for window "), F.col("idx").cast("string"))).cast("string"))
    return joined.select(*manifest.columns, text.alias("text"))


@query("join_orphans", "SELECT page_id AS doc_id, 'missing_export' AS kind FROM pages LEFT JOIN labels l ON page_id = l.doc_id WHERE l.doc_id IS NULL UNION ALL SELECT l.doc_id, 'missing_source' FROM labels l LEFT JOIN pages ON page_id = l.doc_id WHERE page_id IS NULL")
def join_orphans(spark, sf_dir):
    d, e = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(e, "doc_id", "left_anti").withColumn("kind", F.lit("missing_export")).unionByName(e.join(d, "doc_id", "left_anti").withColumn("kind", F.lit("missing_source")))


@query("val_refs", f"WITH {SEG}, r AS (SELECT doc_id, idx // 3 AS chunk, idx + CASE WHEN idx % 5 = 0 THEN 1000 ELSE 0 END AS ref FROM seg) SELECT r.doc_id, chunk, count(*) AS unknown_refs FROM r LEFT JOIN seg ON r.doc_id = seg.doc_id AND ref = idx WHERE idx IS NULL GROUP BY r.doc_id, chunk")
def val_refs(spark, sf_dir):
    s = segments(spark, sf_dir)
    refs = s.groupBy("doc_id", F.floor(F.col("idx") / 3).alias("chunk")).agg(F.collect_list(F.col("idx") + F.when(F.col("idx") % 5 == 0, 1000).otherwise(0)).alias("refs"))
    loose = refs.select("doc_id", "chunk", F.explode("refs").alias("idx")).join(s.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    return loose.groupBy("doc_id", "chunk").agg(F.count("*").alias("unknown_refs"))


@query("val_dupes", "SELECT sha1(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY sha1(text) HAVING count(*) > 1")
def val_dupes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("val_ts_order", f"WITH {SEG}, x AS (SELECT doc_id, idx, CASE WHEN conf % 10 = 0 THEN t1 ELSE t0 END AS a, CASE WHEN conf % 10 = 0 THEN t0 ELSE t1 END AS b FROM seg) SELECT doc_id, idx, a, b FROM x WHERE b < a")
def val_ts_order(spark, sf_dir):
    swap = F.col("conf") % 10 == 0
    x = segments(spark, sf_dir).select("doc_id", "idx", F.when(swap, F.col("t1")).otherwise(F.col("t0")).alias("a"), F.when(swap, F.col("t0")).otherwise(F.col("t1")).alias("b"))
    return x.where("b < a")


@query("val_reconcile", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM documents) - (SELECT count(DISTINCT doc_id) FROM labels) AS unlabelled, (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM documents) AS ids_unique")
def val_reconcile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct("doc_id").alias("ids"))
    e = table(spark, sf_dir, "labels").agg(F.count("*").alias("labels"), F.count_distinct("doc_id").alias("labelled"))
    return d.crossJoin(e).select("documents", "labels", (F.col("documents") - F.col("labelled")).alias("unlabelled"), (F.col("documents") == F.col("ids")).alias("ids_unique"))


@query("join_section_text", f"WITH {SEG}, sc AS (SELECT doc_id, idx // 4 AS section, min(t0) AS a, max(t1) AS b FROM seg GROUP BY doc_id, idx // 4) SELECT sc.doc_id, section, string_agg(text, ' ' ORDER BY idx) AS body FROM sc JOIN seg ON sc.doc_id = seg.doc_id AND t0 >= a - 50 AND t1 <= b + 50 GROUP BY sc.doc_id, section")
def join_section_text(spark, sf_dir):
    s = segments(spark, sf_dir)
    sections = s.groupBy("doc_id", F.floor(F.col("idx") / 4).alias("section")).agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    pairs = intervals.overlap(sections, s.select("doc_id", "idx", "t0", "t1", "text"), ("a", "b"), ("t0", "t1"), tolerance_ms=50).where((F.col("t0") >= F.col("a") - 50) & (F.col("t1") <= F.col("b") + 50))
    return pairs.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("body"))


@query("join_doc_info", f"""WITH {JOBS}, lj AS (SELECT doc, max(id) AS last_job, arg_max(status, id) AS last_status FROM jobs GROUP BY doc), le AS (SELECT doc, max(id) AS last_export FROM jobs WHERE action = 'purchase' GROUP BY doc), rc AS (SELECT conv_id AS doc_id, count(*) AS rules FROM conversations GROUP BY conv_id)
SELECT d.doc_id, coalesce(rules, 0) AS rules, l.quality IS NOT NULL AS stamped, last_job, last_status, last_export FROM documents d LEFT JOIN rc USING (doc_id) LEFT JOIN labels l USING (doc_id) LEFT JOIN lj ON lj.doc = d.doc_id LEFT JOIN le ON le.doc = d.doc_id""")
def join_doc_info(spark, sf_dir):
    j = jobs(spark, sf_dir)
    rules = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("rules"))
    last = j.groupBy(F.col("doc").alias("doc_id")).agg(F.max("id").alias("last_job"), F.max_by("status", "id").alias("last_status"))
    export = j.where("action = 'purchase'").groupBy(F.col("doc").alias("doc_id")).agg(F.max("id").alias("last_export"))
    stamp = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").isNotNull().alias("stamped"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    for other in (rules, stamp, last, export):
        d = d.join(other, "doc_id", "left")
    return d.select("doc_id", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("stamped", F.lit(False)).alias("stamped"), "last_job", "last_status", "last_export")


# Whole words of any length and script; DuckDB's distance compares bytes, so that letters beyond ASCII become control characters, one for one.
ONE_BYTE = "translate({0}, 'çèéêíñóöüäß', " + " || ".join(f"chr({k})" for k in (*range(1, 9), *range(14, 17))) + ")"
WORDS_SQL = f"wv AS (SELECT {ONE_BYTE.format('w')} AS b, w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM conversations) GROUP BY w)"


def vocabulary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("join_fuzzy_lev", f"WITH {WORDS_SQL}, m AS (SELECT a.w AS source, b.w AS target, levenshtein(a.b, b.b) AS d, b.n FROM wv a JOIN wv b ON a.w <> b.w AND abs(length(a.b) - length(b.b)) <= 1 AND b.n >= a.n AND levenshtein(a.b, b.b) <= 1) SELECT source, first(target ORDER BY d, n DESC, target) AS target FROM m GROUP BY source")
def join_fuzzy_lev(spark, sf_dir):
    return fuzzy.one_edit(vocabulary(spark, sf_dir))


@query("join_fuzzy_best")
def join_fuzzy_best(spark, sf_dir):
    return fuzzy.best_gestalt(vocabulary(spark, sf_dir), 0.8)


@query("join_fuzzy_phrase")
def join_fuzzy_phrase(spark, sf_dir):
    s = segments(spark, sf_dir).select("doc_id", "idx", "text")
    # an entry is its segment's text without the last of every four words: some have a close phrase, others only a likely one
    kept = F.filter(F.split("text", r"\s+"), lambda w, k: k % 4 != 3)
    return fuzzy.match_phrases(s, s.select("doc_id", F.col("idx").alias("entry"), F.array_join(kept, " ").alias("text_machine")))


@query("udf_gestalt")
def udf_gestalt(spark, sf_dir):
    """Each segment's ratio with the one before it, both ways: the ratio depends on the order."""
    s = segments(spark, sf_dir)
    pairs = s.select("doc_id", "idx", "text", F.lag("text").over(W.partitionBy("doc_id").orderBy("idx")).alias("before"))
    return pairs.select("doc_id", "idx", text_udf.gestalt("before", "text").alias("ratio"), text_udf.gestalt("text", "before").alias("back"))


MARK_SQL = f"""WITH {SEG}, t AS (SELECT doc_id, idx, regexp_split_to_array(text, '\\s+') AS ws, regexp_extract_all(text, '\\s+') AS gaps FROM seg)
SELECT doc_id, idx, array_to_string(list_transform(ws, lambda w, i: CASE WHEN regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_]', '', 'g') <> '' AND ((i - 1) * 37 + idx * 11 + doc_id) % 100 < 35 THEN '**[' || w || '?]**' ELSE w END || coalesce(gaps[i], '')), '') AS marked FROM t"""


@query("udf_mark_low_conf", MARK_SQL)
def udf_mark_low_conf(spark, sf_dir):
    w = segment_words(spark, sf_dir).groupBy("doc_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word", "p"))), lambda x: F.struct(x["word"].alias("word"), (x["p"] / 100).alias("probability"))).alias("words"))
    s = segments(spark, sf_dir).drop("words").join(w, ["doc_id", "idx"])
    return s.select("doc_id", "idx", text_udf.mark_low("text", "words").alias("marked"))


@query("fn_apply_glossary", f"WITH {SEG} SELECT doc_id, idx, translate(regexp_replace(regexp_replace(regexp_replace(text, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g'), '(?i)' || chr(1) || 'the' || chr(2), chr(1) || 'THE' || chr(2), 'g'), '(?i)(tion)s?' || chr(2), '<\\1>' || chr(2), 'g'), chr(1) || chr(2), '') AS text FROM seg")
def fn_apply_glossary(spark, sf_dir):
    from vocalis.operators import rules

    return segments(spark, sf_dir).select("doc_id", "idx", rules.apply(F.col("text"), [(r"\bthe\b", "THE"), ("[", "never"), (r"(tion)s?\b", r"<\1>")]).alias("text"))
