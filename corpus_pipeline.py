"""A training corpus from `documents`: toxicity, exact dedup, near dedup, source mixing, byte-level BPE ids.

Each stage gets the rows that the one before kept. Rows with equal texts, near copies and null texts are dealt with as
the operators define; an empty table passes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, exact_dedup, mixing, ngram_join, queries, toxicity
from loomgraph.llm.common import cut, documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch at most, so that no text comes twice; a document of which any token is taken stays whole."""
    return mixing.take(docs, mixing.mix(docs, queries.WEIGHTS, queries.PIPELINE_PERCENT, 1, queries.SEED, queries.DOMAIN))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(queries.BPE_FILE)), public_tokenizers.PATTERN, keep_text=False)
    return encoded.select("doc_id", "lang", "source", bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram join", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", encode)]
#: A fitted classifier, classes of a similarity join and BPE ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
