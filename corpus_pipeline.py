"""A corpus pipeline over the documents table: STAGES in order, each stage's rows written and read by the next.

Columns beside those of documents are kept, whatever their names, up to the last stage. Nulls, empty
and repeated rows go through each stage as its operator defines it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm import bpe, language_id, mixing, simhash, suffixes
from cavitas.llm.shared import apart, released, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the predicted language; documents without a letter (null and empty ones, too) have none and go."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, back = apart(docs, "lang_pred", "score")
    found = language_id.predict(own, path, language_id.train(docs, path), tuple(c for c in own.columns if c != "text"))
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*own.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id has, too, go; so do documents that have nothing else. n_chars is that of the text left."""
    own, back = apart(docs, "before")
    rows = suffixes.remove(own.withColumn("before", F.length("text")))
    left = rows.where("coalesce(before, 0) = 0 or length(text) > 0").drop("before")
    return left.withColumn("n_chars", F.length("text").cast("long")).withColumnsRenamed(back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights ask for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and the digest of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: The language model and the tokenizer's merges have no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with released(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
