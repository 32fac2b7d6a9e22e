"""The corpus pipeline: each stage takes what the one before kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attestor.llm import bpe, exact_index, mixing, simhash, toxicity
from attestor.llm.work import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go; the rest stay with all columns.

    Null and empty texts hold no passage and stay, repeated rows stay or go together, a null doc_id is scored like any other. If
    the labels lack a class, or are empty, all stay. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filtered(docs, toxicity.fit(spark, docs, toxicity.learnable(labels)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one document stays, the longest, then that of the smallest doc_id.

    Null, empty and blank texts are one group. Of rows that tie in both one stays; a null doc_id yields to any other. An empty
    table stays empty.
    """
    return exact_index.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id.

    Texts without words, null ones among them, are near nothing and stay. Rows that repeat doc_id and text stay or go together,
    other ties go to the smaller hash; a null doc_id yields to any other. An empty table stays empty.
    """
    return simhash.kept_of_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: rows are repeated or left out, by hash of doc_id.

    A null source is a source of its own, the last; null and empty texts have size zero and are repeated like their source's others.
    Rows that repeat a doc_id are drawn alike. An empty table stays empty.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix: doc_id, n_tokens and the digests of ids and decoded text.

    Null and empty texts have no tokens. Rows are independent of each other; an empty table gives an empty result.
    """
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores and subword merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
