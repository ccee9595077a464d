"""A training-data pipeline of five corpus operators over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes its result to the shared folder and reads it again as the
next stage's input.

Null, empty and letterless texts go in the first stage; the others would keep
them as their operators say.  Null ids and repeated rows are judged like others
until near_dedup keeps one row of each group.  Empty tables stay empty, and
columns beside ``doc_id`` and ``text`` pass all stages but the last unread,
whatever their names; only ``n_chars`` is counted anew where a text is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from portfolia.llm import bpe, decontaminate, language, simhash, suffix
from portfolia.llm.common import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is identified with a score of a half or more; texts that are null or have no letters go."""
    return language.reject_unknown(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: that of the smallest doc_id, null the largest."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages of 50 words that an earlier place has too; documents of which nothing is left go."""
    return suffix.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which a twentieth of the words or more is benchmark passages; null items and documents have no words."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each document; ids themselves come from ``bpe.encode_decode``."""
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [("language_id", identify_language), ("near_dedup", near_dedup), ("suffix_dedup", passage_dedup), ("decontaminate", decontamination), ("bpe", encode)]

#: Fingerprints, learned language models and token ids have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
