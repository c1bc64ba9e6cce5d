"""Corpus pipeline over documents: each stage works on all that the one before it kept.

Stages take and return the columns of documents (doc_id, text, lang, source, n_chars) but for the last, which returns
the token digests of what is left. What each does with nulls, empty texts and repeated rows stands with its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import decontaminate, line_dedup, quality, sentencepiece_bpe, simhash
from stackloom.llm.common import materialise, ready

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; rows that share a doc_id are judged each by its text."""
    docs = docs.select(*COLUMNS)
    ready(spark)
    stats = materialise(quality.statistics(docs, list(COLUMNS[1:])), "statistics")
    kept = quality.scored(stats, quality.train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")), list(COLUMNS[1:]))
    return kept.where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the later copies of repeated line runs; n_chars counts what is left."""
    found = line_dedup.remove_runs(docs, keep=("lang", "source"))
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return simhash.representatives(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    found = decontaminate.find_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document left."""
    return sentencepiece_bpe.encode_decode(docs, text=False).drop("ids", "decoded")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: No SQL: classifier, fingerprints and tokens are beyond it; tests hold each stage against its operator by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written as Parquet and read again."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
