"""A training-data pipeline over ``documents``: quality, near duplicates, repeated passages, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, near_dedup, quality_crf, suffix_dedup
from tidemark.llm._spark import discard, materialize, table
from tidemark.llm.queries import EPOCHS, SEED, THRESHOLD, WEIGHTS, learnable, mixture_levels, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good; the field is fitted on documents that aren't held out."""
    field = quality_crf.fit(docs, learnable(table(spark, sf_dir, "labels"), 5, 0))
    return quality_crf.keep_good(docs, field, THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (word 5-shingles, similarity 0.8 or more): the smallest id."""
    return near_dedup.drop_near_duplicates(docs, shingle=5, numerator=4, denominator=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document with a smaller id has too."""
    return suffix_dedup.cut_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture; one that is taken in two epochs is two rows."""
    return mixing.mix_sources(docs, mixture_levels(), WEIGHTS, epochs=EPOCHS, seed=SEED).select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]

#: The stages' models, component search and tokenizer can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
