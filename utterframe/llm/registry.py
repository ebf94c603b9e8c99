"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.llm import decontaminate, hmm_lm, language_id, license_scan, line_dedup, nearest, packing, pii, simhash_dedup, url_filter
from utterframe.llm.common import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op5_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(read_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    per_kind = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *per_kind, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), F.col("added").alias("n_added"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["first"])
    of = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda p: p["label"]) for c in cols]))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), of("places").alias("base_labels"), of("places", "regions").alias("labels"), "score")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, l, unnest(range(len(l))) AS pos FROM d),
w AS (SELECT doc_id, pos, l[pos + 1] AS a, l[pos + 2] AS b, l[pos + 3] AS c FROM e WHERE pos + 3 <= len(l)),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w),
g AS (SELECT DISTINCT doc_id, pos + s AS pos FROM o, (VALUES (0), (1), (2)) v(s) WHERE k > 1),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN e.l[e.pos + 1] END, chr(10) ORDER BY e.pos) AS text
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_nearest, op4_url_filter, op5_hmm_scoring, op6_pii, op7_simhash_dedup, op8_license_scan, op9_best_fit_packing, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": url_filter.ORACLE_SQL, "op10_line_dedup": OP10_SQL}
