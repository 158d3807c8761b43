"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellgauge.llm import bpe, chat, ctw, divergence, langid, lattice, phrase, repair, shards, simhash, spelling, stages, toxicity, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.digests(table(spark, sf_dir, "documents"))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases in all documents."""
    return phrase.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return langid.predictions(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return stages.run(spark, sf_dir)


@query("op1_chat_format", chat.ORACLE)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as reply trees, formatted and read back."""
    return chat.digests(table(spark, sf_dir, "conversations"))


@query("op4_lattice_dedup")
def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_interleave")
def op5_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents, in the mixture of their sources."""
    return shards.digests(table(spark, sf_dir, "documents"))


@query("op2_warc_index", warc.ORACLE)
def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, found through the capture index and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_context_tree")
def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the context tree and under the word base."""
    held = langid.remainder("doc_id", 5) == 1
    return ctw.scores(table(spark, sf_dir, "documents"), held)


@query("op8_repair")
def op8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as grammars and read back."""
    return repair.digests(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op11_source_divergence", divergence.ORACLE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of sources and their terms above their language's share, over all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants", spelling.ORACLE)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words, forms and roots."""
    return spelling.groups(table(spark, sf_dir, "documents"))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels that are not held out."""
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
