"""Scans, sinks' text formats and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalis.operators import quality, rules
from vocalis.plans.registry import query
from vocalis.sources import formats
from vocalis.sources.adapters import JOBS, LINES, SEG, SEGW, UTT, jobs, lines, segment_words, segments, table, utterances


@query("src_segments", f"WITH {SEG} SELECT doc_id, idx, speaker, trim(text) AS text, words, t0 / 1000 AS start_s, t1 / 1000 AS end_s, substr(sha1(doc_id::VARCHAR || '|' || idx::VARCHAR), 1, 12) AS segment_id FROM seg WHERE trim(text) <> ''")
def src_segments(spark, sf_dir):
    s = segments(spark, sf_dir).where(F.trim("text") != "")
    key = F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("idx").cast("string"))
    return s.select("doc_id", "idx", "speaker", F.trim("text").alias("text"), "words", (F.col("t0") / 1000).alias("start_s"), (F.col("t1") / 1000).alias("end_s"), F.substring(F.sha1(key), 1, 12).alias("segment_id"))


@query("src_chunks_coalesce", f"WITH {SEG}, c AS (SELECT doc_id, idx, CASE WHEN idx % 3 = 0 THEN t0 / 1000 END AS start, CASE WHEN idx % 3 = 1 THEN t0 / 1000 END AS ts_start, CASE WHEN idx % 3 = 2 THEN t0 / 1000 END AS t0 FROM seg) SELECT doc_id, idx, coalesce(nullif(start, 0), nullif(ts_start, 0), t0, 0.0) AS start_s FROM c")
def src_chunks_coalesce(spark, sf_dir):
    s = segments(spark, sf_dir)
    spelled = s.select("doc_id", "idx", *[F.when(F.col("idx") % 3 == k, F.col("t0") / 1000).alias(n) for k, n in enumerate(("start", "ts_start", "t0"))])
    return spelled.select("doc_id", "idx", formats.first_true("start", "ts_start", "t0").alias("start_s"))


@query("src_text_only", "SELECT conv_id AS doc_id, turn AS idx, text FROM conversations WHERE text <> ''")
def src_text_only(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text <> ''").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")


@query("src_priority", """WITH a AS (SELECT doc_id, 1 AS priority, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT conv_id, 2, string_agg(text, chr(10) ORDER BY turn) FROM conversations GROUP BY conv_id UNION ALL SELECT page_id, 3, url FROM pages)
SELECT doc_id, min(priority)::INT AS priority, arg_min(text, priority) AS text FROM a GROUP BY doc_id""")
def src_priority(spark, sf_dir):
    clean = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.lit(1).alias("priority"), "text")
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(3).alias("priority"), F.col("url").alias("text"))
    return formats.first_available(clean.unionByName(c.withColumn("priority", F.lit(2))).unionByName(pages))


@query("src_corrupt_rows", "SELECT event_id AS line_no, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k, event_id % 7 = 0 AS corrupt FROM events")
def src_corrupt_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("line"))
    return formats.parse_json_lines(e, "line", "k bigint").select(F.col("event_id").alias("line_no"), "k", "corrupt")


@query("agg_last_wins", "SELECT user_id AS chunk_id, max(event_id) AS line_no, arg_max(event_type, event_id) AS payload FROM events GROUP BY user_id")
def agg_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("payload"))
    return formats.last_wins(e, "chunk_id", "line_no")


@query("src_lines", f"WITH {LINES} SELECT doc_id, pos, line, trim(line) = '' AS blank FROM ln")
def src_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", "line", (F.trim("line") == "").alias("blank"))


@query("top_latest_version", "SELECT source AS doc, arg_max('v' || doc_id::VARCHAR, n_chars * 1000000 + doc_id) AS version, max(n_chars) AS mtime FROM documents GROUP BY source")
def top_latest_version(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("doc")).agg(F.max_by(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.struct("n_chars", "doc_id")).alias("version"), F.max("n_chars").alias("mtime"))


@query("src_words", f"WITH {SEG}, {SEGW} SELECT doc_id, idx, k, word, w0 / 1000 AS start_s, w1 / 1000 AS end_s, p / 100 AS score FROM sw WHERE p % 10 <> 3")
def src_words(spark, sf_dir):
    w = segment_words(spark, sf_dir)
    raw = w.withColumn("score", F.when(F.col("p") % 10 == 3, F.lit("n/a")).otherwise((F.col("p") / 100).cast("string")))
    return raw.withColumn("score", F.expr("try_cast(score AS double)")).where("score IS NOT NULL").select("doc_id", "idx", "k", "word", (F.col("w0") / 1000).alias("start_s"), (F.col("w1") / 1000).alias("end_s"), "score")


@query("fn_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("fn_preview", "SELECT doc_id, substr(text, 1, 1200) AS preview, length(text) > 1200 AS cut FROM documents")
def fn_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 1200).alias("preview"), (F.length("text") > 1200).alias("cut"))


@query("pred_doc_id_valid", "SELECT page_id, url, regexp_full_match(regexp_replace(url, '^https?://', ''), '[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*') AS valid FROM pages")
def pred_doc_id_valid(spark, sf_dir):
    name = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", name.rlike("^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$").alias("valid"))


@query("agg_storage", "SELECT source AS dir, count(*) AS files, sum(n_chars)::BIGINT AS bytes, min(doc_id) AS oldest, max(doc_id) AS newest FROM documents GROUP BY source")
def agg_storage(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dir")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"))


@query("topk_heavy", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def topk_heavy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("agg_audit_report", """SELECT 'documents' AS metric, count(*)::BIGINT AS value FROM documents UNION ALL SELECT 'bytes', sum(n_chars)::BIGINT FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents
UNION ALL SELECT 'missing_export', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def agg_audit_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    missing = d.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("missing_export"))
    wide = d.agg(F.count("*").alias("documents"), F.sum("n_chars").alias("bytes"), F.count_distinct("source").alias("sources"))
    return wide.unpivot([], ["documents", "bytes", "sources"], "metric", "value").unionByName(missing.unpivot([], ["missing_export"], "metric", "value"))


MMSS = "lpad((ms // 60000)::VARCHAR, greatest(2, length((ms // 60000)::VARCHAR))::INT, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0')"
STAMP = "lpad(({0} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({0} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 1000 % 60)::VARCHAR, 2, '0') || '{1}' || lpad(({0} % 1000)::VARCHAR, 3, '0')"


@query("fmt_txt", f"WITH {SEG} SELECT doc_id, string_agg(CASE WHEN speaker <> '' THEN speaker || ': ' ELSE '' END || text, chr(10) ORDER BY idx) AS body FROM seg GROUP BY doc_id")
def fmt_txt(spark, sf_dir):
    return formats.RENDERERS["txt"](segments(spark, sf_dir))


@query("fmt_md", f"WITH {SEG}, l AS (SELECT doc_id, idx, t0 AS ms, speaker, text FROM seg) SELECT doc_id, string_agg('## ' || {MMSS} || ' ' || speaker || chr(10) || text, chr(10) ORDER BY idx) AS body FROM l GROUP BY doc_id")
def fmt_md(spark, sf_dir):
    return formats.RENDERERS["md"](segments(spark, sf_dir))


for _name, _mark in (("fmt_srt", ","), ("fmt_vtt", ".")):

    @query(_name, f"WITH {SEG} SELECT doc_id, string_agg((idx + 1)::VARCHAR || chr(10) || {STAMP.format('t0', _mark)} || ' --> ' || {STAMP.format('t1', _mark)} || chr(10) || text, chr(10) || chr(10) ORDER BY idx) AS body FROM seg GROUP BY doc_id")
    def fmt_subtitles(spark, sf_dir, mark=_mark):
        return formats.subtitles(segments(spark, sf_dir), mark)


@query("fmt_rttm", f"WITH {UTT} SELECT doc_id, idx, 'SPEAKER d' || doc_id::VARCHAR || ' 1 ' || (t0 // 1000)::VARCHAR || '.' || lpad((t0 % 1000)::VARCHAR, 3, '0') || ' ' || ((t1 - t0) // 1000)::VARCHAR || '.' || lpad(((t1 - t0) % 1000)::VARCHAR, 3, '0') || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS line FROM utt")
def fmt_rttm(spark, sf_dir):
    s = lambda c: F.concat(F.expr(f"({c}) div 1000").cast("string"), F.lit("."), F.lpad(F.expr(f"({c}) % 1000").cast("string"), 3, "0"))
    return utterances(spark, sf_dir).select("doc_id", "idx", F.concat(F.lit("SPEAKER d"), F.col("doc_id").cast("string"), F.lit(" 1 "), s("t0"), F.lit(" "), s("t1 - t0"), F.lit(" <NA> <NA> "), "speaker", F.lit(" <NA> <NA>")).alias("line"))


@query("fmt_json", f"""WITH {SEG} SELECT doc_id, '{{"meta":{{"schema_version":"1.0.0","segments":' || count(*)::VARCHAR || '}},"segments":[' || string_agg('{{"idx":' || idx::VARCHAR || ',"t0":' || t0::VARCHAR || ',"t1":' || t1::VARCHAR || ',"speaker":' || to_json(speaker)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}}', ',' ORDER BY idx) || ']}}' AS body FROM seg GROUP BY doc_id""")
def fmt_json(spark, sf_dir):
    return formats.RENDERERS["json"](segments(spark, sf_dir))


@query("fmt_clean_txt", f"WITH {SEG} SELECT doc_id, string_agg(CASE WHEN idx % 4 = 0 THEN '# Section ' || (idx // 4 + 1)::VARCHAR || chr(10) ELSE '' END || text, chr(10) ORDER BY idx) AS body FROM seg GROUP BY doc_id")
def fmt_clean_txt(spark, sf_dir):
    return formats.RENDERERS["clean_txt"](segments(spark, sf_dir))


@query("fmt_readme", """SELECT 'src' || r AS name, 'source: ' || source || chr(10) || 'documents: ' || n::VARCHAR || chr(10) || 'characters: ' || c::VARCHAR || chr(10) || 'config: ' || substr(sha256(source || '|' || n::VARCHAR), 1, 16) AS body
FROM (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS c, row_number() OVER (ORDER BY source) AS r FROM documents GROUP BY source)""")
def fmt_readme(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c")).withColumn("r", F.row_number().over(W.orderBy("source")))
    body = F.concat_ws("\n", F.concat(F.lit("source: "), "source"), F.concat(F.lit("documents: "), F.col("n").cast("string")), F.concat(F.lit("characters: "), F.col("c").cast("string")), F.concat(F.lit("config: "), F.substring(F.sha2(F.concat("source", F.lit("|"), F.col("n").cast("string")), 256), 1, 16)))
    return g.select(F.concat(F.lit("src"), F.col("r").cast("string")).alias("name"), body.alias("body"))


@query("fn_schema_stamp", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN '1.0.0' END, '1.0.0') AS schema_version FROM documents")
def fn_schema_stamp(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "1.0.0").alias("schema_version"))
    return formats.stamp_schema(d)


# Rule sets and other sets.
# Two rule sets that the tables give: names of sources, and codes of languages with rules that are blank or don't compile.
RULES_SQL = """a AS (SELECT source AS pattern, upper(source) AS replacement, row_number() OVER (ORDER BY source) AS pos FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
l AS (SELECT coalesce(lang, '') AS lang, min(source) AS source FROM documents GROUP BY lang),
b AS (SELECT pattern, replacement, row_number() OVER (ORDER BY pattern, replacement) AS pos FROM (SELECT lang AS pattern, upper(lang) AS replacement FROM l UNION SELECT '[' || lang, lang FROM l UNION SELECT source, 'of ' || lang FROM l WHERE source IS NOT NULL UNION SELECT source, upper(source) FROM l WHERE source IS NOT NULL))"""


def rule_sets(spark, sf_dir):
    """(pattern, replacement, pos) twice."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    a = d.where("source is not null").groupBy(F.col("source").alias("pattern")).agg(F.upper("source").alias("replacement"))
    langs = d.groupBy("lang").agg(F.min("source").alias("source")).select(F.coalesce("lang", F.lit("")).alias("lang"), "source")
    pairs = F.array(*[F.struct(p.alias("pattern"), r.alias("replacement")) for p, r in ((F.col("lang"), F.upper("lang")), (F.concat(F.lit("["), "lang"), F.col("lang")), (F.col("source"), F.concat(F.lit("of "), "lang")), (F.col("source"), F.upper("source")))])
    b = langs.select(F.inline(pairs)).where("pattern is not null").distinct()
    placed = lambda df: df.withColumn("pos", F.row_number().over(W.orderBy("pattern", "replacement")).cast("long"))  # noqa: E731  a rule set is small
    return placed(a), placed(b)


@query("set_union_rules", f"WITH {RULES_SQL}, u AS (SELECT pattern, replacement, pos FROM a UNION ALL SELECT pattern, replacement, pos + 1000 FROM b) SELECT pattern, replacement, min(pos)::BIGINT AS pos FROM u GROUP BY pattern, replacement")
def set_union_rules(spark, sf_dir):
    return rules.union(*rule_sets(spark, sf_dir))


@query("set_rules_validate", f"WITH {RULES_SQL} SELECT pattern, arg_max(replacement, pos) AS replacement FROM (SELECT * FROM a UNION ALL SELECT pattern, replacement, pos + 1000 FROM b) WHERE trim(pattern) <> '' AND pattern NOT LIKE '[%' GROUP BY pattern")
def set_rules_validate(spark, sf_dir):
    a, b = rule_sets(spark, sf_dir)
    found = a.unionByName(b.withColumn("pos", F.col("pos") + 1000)).orderBy("pos").limit(rules.MOST_RULES + 1).collect()  # more raise
    return spark.createDataFrame(rules.validate([(r.pattern, r.replacement) for r in found]), "pattern string, replacement string")


@query("topn_rules", f"WITH {RULES_SQL} SELECT pattern, replacement FROM a ORDER BY pos LIMIT 10")
def topn_rules(spark, sf_dir):
    """The first ten rules of a set, which is what an application of so many uses."""
    return rule_sets(spark, sf_dir)[0].orderBy("pos").limit(10).select("pattern", "replacement")


@query("set_except", "SELECT doc_id, 'missing_export' AS side FROM (SELECT page_id AS doc_id FROM pages EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'missing_source' FROM (SELECT doc_id FROM labels EXCEPT SELECT page_id FROM pages)")
def set_except(spark, sf_dir):
    d, e = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), table(spark, sf_dir, "labels").select("doc_id")
    return d.subtract(e).withColumn("side", F.lit("missing_export")).unionByName(e.subtract(d).withColumn("side", F.lit("missing_source")))


@query("set_union_terms", "SELECT DISTINCT lower(term) AS term FROM (SELECT source AS term FROM documents UNION ALL SELECT upper(lang) FROM documents UNION ALL SELECT role FROM conversations)")
def set_union_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    terms = d.select(F.col("source").alias("term")).union(d.select(F.upper("lang"))).union(table(spark, sf_dir, "conversations").select("role"))
    return terms.select(F.lower("term").alias("term")).distinct()


@query("set_terms", "SELECT lang AS term FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) ORDER BY term")
def set_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("term")).distinct().orderBy("term")


@query("set_distinct_ordered", "SELECT conv_id AS doc_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, lower(trim(role)) AS role, min(turn) AS first FROM conversations GROUP BY conv_id, lower(trim(role))) GROUP BY conv_id")
def set_distinct_ordered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("doc_id", F.array_join(F.array_distinct(F.transform("r", lambda x: F.lower(F.trim(x["role"])))), ",").alias("roles"))


@query("sink_low_conf_csv", f"""WITH {SEG}, {SEGW}, low AS (SELECT doc_id, idx, word, w0, w1, p FROM sw WHERE p < 20), g AS (SELECT *, CASE WHEN w0 - lag(w1) OVER (PARTITION BY doc_id, idx ORDER BY w0) <= 200 THEN 0 ELSE 1 END AS fresh FROM low),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, idx ORDER BY w0) AS isl FROM g)
SELECT doc_id, idx, word, w0, w1, (p // 100)::VARCHAR || '.' || lpad((p % 100 * 10)::VARCHAR, 3, '0') AS score FROM low UNION ALL
SELECT doc_id, idx, '[cluster]', min(w0), max(w1), (sum(p) * 10 // count(*) // 1000)::VARCHAR || '.' || lpad((sum(p) * 10 // count(*) % 1000)::VARCHAR, 3, '0') FROM i GROUP BY doc_id, idx, isl HAVING count(*) >= 3""")
def sink_low_conf_csv(spark, sf_dir):
    return quality.low_confidence_rows(segment_words(spark, sf_dir), 20)


@query("proj_manifest", """SELECT source AS doc, to_json({documents: count(*), characters: sum(n_chars)::BIGINT, first: min(doc_id)})::VARCHAR AS manifest, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS provenance FROM documents GROUP BY source""")
def proj_manifest(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return g.agg(F.to_json(F.struct(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.min("doc_id").alias("first"))).alias("manifest"), F.sha2(ids, 256).alias("provenance"))


@query("win_segmenter", "WITH d AS (SELECT doc_id, n_chars * 60 AS total FROM documents) SELECT doc_id, w::BIGINT AS idx, (w * 67000)::BIGINT AS start_ms, least(w * 67000 + 75000, total)::BIGINT AS end_ms FROM d, LATERAL (SELECT unnest(range(0, (total + 66999) // 67000)) AS w)")
def win_segmenter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 60).alias("total"))
    return formats.windows(d, "total", 75_000, 8_000)


@query("agg_jobs_storage", f"WITH {JOBS} SELECT doc, count(*) AS jobs, sum(duration_ms)::BIGINT AS busy_ms FROM jobs GROUP BY doc")
def agg_jobs_storage(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("jobs"), F.sum("duration_ms").alias("busy_ms"))
