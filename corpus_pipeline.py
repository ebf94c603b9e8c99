"""Corpus pipeline: documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.durable import durable
from utterframe.llm import decontaminate, fuzzy_dedup, language_id, line_dedup, packing, simhash_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language, go: null and empty texts among them.  Repeated rows stay or go together."""
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; a document of which nothing is left goes.

    ``n_chars``, where there is such a column, is that of the text that is left; all other columns
    stay, of any name.  Null texts stay as they are.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")) if rest else docs
    cleaned = line_dedup.dedup_lines(rows).filter("n_removed = 0 or n_removed < n_lines")
    left = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"rest.`{c}`") for c in rest}
    if "n_chars" in rest:
        left["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(left["n_chars"])
    return cleaned.select(*[left[c].alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that five-word shingles of similarity 0.8 or more link; op7's contract does not bind here.

    The one with the smallest id stays, with all its columns.  Null and wordless texts are one group;
    a row without an id stays only where its group has none with one.
    """
    return simhash_dedup.keep_one(docs, near=fuzzy_dedup.near_duplicates)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised, cut and packed, a row for each piece; a null or empty text is the end id alone."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", decontaminate_benchmark),
    ("pack", pack_sequences),
]

#: Profiles, shingle hashes and tokenisation are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is cut off from its lineage, so nothing runs twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
