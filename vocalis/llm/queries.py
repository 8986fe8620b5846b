"""The queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocalis.llm import decontaminate, jaccard, language, licences, media, merkle, mixing, quantiles, simhash, substrings, suffixes, tokens, toxicity
from vocalis.llm.frames import documents


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir))


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op7_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op8_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir))


def op9_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


def op10_suffix_family_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(documents(spark, sf_dir))


def op11_ball_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op12_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantiles.shop(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sale_lines", "items")])
    return quantiles.audit(rows, ["stream", "grp"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank FROM d GROUP BY source
), w AS (
  SELECT *, ([5.0, 2.0, 1.0])[((source_rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size::DOUBLE * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_rank, source_size,
         CASE WHEN cap / weight <= level THEN cap ELSE max(CASE WHEN cap / weight > level THEN level END) OVER () * weight END AS target FROM l
), p AS (
  SELECT d.*, t.source_rank, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (copy * source_size + upto)::DOUBLE / target AS finish FROM p, (VALUES (0), (1), (2)) r(copy) WHERE size > 0 AND target > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, copy, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS running FROM c
), k AS (
  SELECT doc_id, key, size, source_rank, upto, count(*) AS n FROM r WHERE running <= (SELECT sum(size) FROM d) GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(k.n, 0))::BIGINT AS taken
FROM p LEFT JOIN k ON p.doc_id IS NOT DISTINCT FROM k.doc_id AND p.key = k.key AND p.size = k.size AND p.source_rank = k.source_rank AND p.upto = k.upto
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_decontamination": op1_simhash_decontamination,
    "op2_weighted_fair_mix": op2_weighted_fair_mix,
    "op3_super_kmer_dedup": op3_super_kmer_dedup,
    "op4_classifier_chain": op4_classifier_chain,
    "op5_trie_token_counts": op5_trie_token_counts,
    "op6_tiff_pages": op6_tiff_pages,
    "op7_licence_classifier": op7_licence_classifier,
    "op8_signature_tree_join": op8_signature_tree_join,
    "op9_nearest_centroid_language": op9_nearest_centroid_language,
    "op10_suffix_family_dedup": op10_suffix_family_dedup,
    "op11_ball_simhash_components": op11_ball_simhash_components,
    "op12_quantile_summaries": op12_quantile_summaries,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def oracles() -> dict[str, str]:
    """Made when asked for: the SQL of op7 holds its trained weights."""
    return {"op2_weighted_fair_mix": OP2_SQL, "op7_licence_classifier": licences.oracle_sql(), "op12_quantile_summaries": quantiles.ORACLE_SQL, "op13_merkle_manifest": merkle.oracle_sql()}
