"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next one reads it.

1. language_id     rows whose language is unknown (no letter in the text) go; all others stay
2. exact_dedup     one row of each group of texts that are equal without white space stays
3. near_dedup      rows go whose text is alike (Jaccard similarity 0.8 of five-word shingles) to one that stays;
                   SimHash fingerprints find them
4. mixing          each row is repeated or left out, so that sources come near their target weights
5. sentencepiece   each row is encoded and decoded again: doc_id, ids, n_tokens, text

Nulls, ties, repeated rows and empty tables are handled as the operators' docstrings say. Stages 1 to 4
return the columns of their input, whatever they are, and need doc_id, text and (1) lang, (4) source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, langid, mixing, near_copies, sentencepieces
from tidewatch.llm.common import shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.accepted(docs, prototypes)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(docs, sentencepieces.load())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

# SQL has neither the vectors of stage 1 nor XXH64; the tests hold each stage against a version without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
