"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read again as the next one's input.

Toxic documents go, one document of each group of near duplicates stays, personal data is masked, documents are drawn to
target weights of quality, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import bpe, mixing, ngram_join, pii, toxicity
from leafloom.llm.common import table, written

#: Target weights of documents of high and low quality: where more than a twentieth is of low quality, only such documents go.
QUALITY = (0.95, 0.05)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.reject_toxic(docs, toxicity.learn(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays; rows without an id stay; rows equal in id and text count once."""
    return ngram_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.learn(docs))


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"), QUALITY, F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("pii", mask_personal_data), ("mixing", mix_quality), ("bpe", encode)]

#: No stage but the second can be told in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
