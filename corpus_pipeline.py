"""Corpus pipeline: quality rules, near duplicates, personal data, packing."""

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import near_dedup, packing, pii, quality_rules
from trackloom.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 2048."""
    return packing.pack_documents(docs, os.fspath(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

# Learned rules and the tokenizer can't be stated in SQL; tests hold the run against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written before the next reads it.

    Null, empty and blank texts go in the first stage, as too short; so no stage after
    it meets one. Rows that share a doc_id are one document to the second stage, which
    keeps one of them; rows without one stay unless the first stage rejects them. Ties
    go by the smaller doc_id. Extra columns pass through to the last stage, whatever
    their names. Empty documents give an empty result; without labels no rule is learned.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
