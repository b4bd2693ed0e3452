"""The corpus pipeline: five stages over the documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, langid, mixing, packing, quality
from millrace.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's thresholds go."""
    return quality.good_documents(docs, Scratch(spark))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go; a null lang is filled with the prediction."""
    return langid.spoken_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles or more, the row with the smallest id stays."""
    return jaccard.first_of_each(docs, Scratch(spark), k=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at weights 3, 1, 2 and 150 % of all words; a document taken twice is there twice."""
    return mixing.mixed_documents(docs, Scratch(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 2048 tokens."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: SQL has no BPE tokenizer and no language classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; every result but the last is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.put(docs, f"stage{i}")
            scratch.keep(f"stage{i}")
    return docs
