"""The registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import exact_dedup, language_id, license_scan, line_dedup, media, mixing, near_dedup, packing, token_table, toxicity
from keyloom.llm.common import documents, pick


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir)).drop("text_md5")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max").drop("text_md5")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    digest = F.sha2("kept_text", 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest, line_dedup.runs_text(F.col("keep_bitmap")).alias("keep_runs"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, (c.key IS NOT NULL AND k.doc_id <> c.keep_id) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key),
whole AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id),
islands AS (
  SELECT doc_id, min(pos) - 1 AS start, count(*) AS length
  FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked WHERE NOT gone)
  GROUP BY doc_id, island),
runs AS (
  SELECT doc_id, string_agg(start || '+' || length, ',' ORDER BY start) AS keep_runs FROM islands GROUP BY doc_id)
SELECT whole.*, coalesce(keep_runs, '') AS keep_runs FROM whole LEFT JOIN runs USING (doc_id)
"""


def op3_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_table.write_tables(documents(spark, sf_dir), token_table.vocabulary_path())
    return token_table.read_tables(manifest)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("spans")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.media_features(media.text_media(documents(spark, sf_dir))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(pick(docs, "doc_id", "text", "lang").where(~language_id.held_out()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.grade_documents(docs, model)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(documents(spark, sf_dir))
    shards = F.array_join(F.col("shards").cast("array<string>"), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_table": op3_token_table,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_media_columns": op6_media_columns,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_source_mixing": op10_source_mixing,
    "pipeline": corpus_pipeline.run,
}
# Encoding by a vocabulary, automata over texts, images and fitted models have no SQL; tests hold them against brute force.
ORACLES = {"op2_exact_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
