"""The corpus pipeline: language ID, near duplicates, secrets, mixing, tokens. Each stage works on all that its
predecessor kept and is written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe, common, language, mixing, secrets, simhash

#: SQL has no trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None
#: Predictions below this are no language; with four languages, chance is 0.25.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a known language; those without letters, or like no language, go. Repeated rows are judged alike."""
    model = language.fit(docs.where(language.fold(F.col("doc_id")) != 1))
    return language.keep(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the row with the smallest id stays, null ids last."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced by a mark."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it. Rows are taken by their content: reruns agree, repeated rows share what falls to them."""
    return mixing.taken(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, lang, source of every row, repeated ones included; no tokens for a null or empty text."""
    return bpe.encode(docs, *bpe.default_vocabulary(), others=("lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = common.new_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
