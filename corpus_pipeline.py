"""The corpus pipeline: stages in order, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns that they were given, without the documents that they reject.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalyx.llm import bpe, decontaminate, exact_dedup, language_id, ngram_jaccard
from zonalyx.llm.queries import BPE_RANKS, tokenizers
from zonalyx.llm.store import keep
from zonalyx.operators.store import drop, recorded

#: Tables that the last stage kept; its result is written before the next stage begins.
_kept: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stage before kept, unless docs still read it."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _kept and not any(p.rpartition("/")[2] in file for file in docs.inputFiles() for p in _kept):
            drop(spark, _kept)
        with recorded(_kept):
            return f(spark, docs, sf_dir)

    return run_stage


#: A document goes if its language is unknown or less probable than this.
MIN_LANGUAGE_SCORE = 0.3


@stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels name; null and letterless texts go."""
    model = language_id.train(language_id.training_rows(docs))
    return language_id.keep_languages(docs, model, MIN_LANGUAGE_SCORE)


@stage
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs, keep_largest=True)


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest doc_id; rows are told apart by id and text."""
    return ngram_jaccard.drop_near_duplicates(docs)


@stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256."""
    public = tokenizers()
    got = bpe.tokenise(docs.select("doc_id", "text"), public.path(BPE_RANKS), public.PATTERN, carry=["doc_id"])
    digests = F.col("__ids_sha256").alias("ids_sha256"), F.col("__decoded_sha256").alias("decoded_sha256")
    return got.select("doc_id", bpe.n_tokens(), F.col("__ids").alias("token_ids"), *digests)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", encode_stage),
]

#: SQL can't express the classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, one in STAGES[:-1]:
        docs = keep(one(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
