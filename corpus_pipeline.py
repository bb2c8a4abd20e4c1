"""The corpus pipeline: quality filter, exact dedup, near-dedup, mixing, tokenising, each over all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.bpe import encode_decode
from lamina.llm.common import Work, table
from lamina.llm.exact_dedup import keep_first
from lamina.llm.mixing import mix
from lamina.llm.near_copies import keep_one
from lamina.llm.quality import keep_good
from lamina.llm.queries import VOCABULARY

#: The mix takes toxic documents down to this share; clean ones keep their tokens. Posteriors of clean documents alone make up over half of it.
TARGETS = {"clean": 0.995, "toxic": 0.005}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that steps of similarity 0.8 or more link, on shingles of five words, the smallest doc_id stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, at the budget at which clean documents keep their tokens."""
    labels = table(spark, sf_dir, "labels")
    labelled = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    return mix(docs, labelled, TARGETS, budget="clean")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests and number of tokens of each document of the mix."""
    return encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    work, docs = Work(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
