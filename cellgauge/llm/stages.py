"""Stages of the corpus pipeline; each calls one operator on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.llm import bpe, langid, phrase, simhash
from cellgauge.llm.store import new_path
from cellgauge.llm.wide import Similar

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: No stage can be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; null texts and those without letters go."""
    return langid.accepted_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Near-duplicates are texts whose sets of five-word shingles have a similarity of 0.8 or
    more, estimated from 256 bits of SimHash, and what these connect. Null and wordless texts
    are one group; a row without an id goes if its group has one with an id; rows that share
    an id are told apart by their texts; repeated rows leave one; no rows give none.
    """
    return simhash.kept_documents(docs, Similar())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Each row is judged by its own text, also where ids repeat or are null. Null, empty and
    wordless texts stay; an empty benchmark keeps all; no rows give none.
    """
    return phrase.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, which decode to its text again, and their digests.

    A null or empty text has no ids and the digest of nothing; repeated rows stay repeated, a
    null id stays null; no rows give none.
    """
    done = bpe.encode(docs, RANKS, table=bpe.token_bytes(spark, RANKS))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokenization),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
