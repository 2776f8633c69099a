"""A training corpus from raw documents, stage by stage.

Each stage works on all that the one before it kept, is written to the shared folder and read again by
the next, so an executor lost in one stage costs no other. All but the last return the columns of
``documents``.

1. ``toxicity``: rows whose learned score reaches the threshold go.
2. ``exact_dedup``: of equal texts (A-Z folded) the one with the largest id stays.
3. ``near_dedup``: of each component of near-duplicates (five words, Jaccard 0.8) one stays.
4. ``mixing``: documents are sampled towards the target weights.
5. ``bpe``: what is left is encoded and decoded; one row for each document with digests of both.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from setframe.llm import bpe, exact_dedup, minhash_forest, mixing, toxicity
from setframe.session import materialise

TOXIC = 0.7
MIXTURE = mixing.Mixture(budget=0.8)
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learned_from(docs, labels)
    return docs.where(toxicity.toxicity("text", lexicon) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.without_near_duplicates(docs, threshold=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs, MIXTURE)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, vocabulary)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix), ("bpe", tokenize)]

# The learned lexicon, the forest and the encoding cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
