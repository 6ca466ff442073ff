"""Corpus pipeline: five stages over the documents, each written and read again.

Every stage is (name, function); the function takes (spark, docs, sf_dir) and returns the rows that go on,
with the columns of documents, but for the last, which returns the packed pieces. A stage works on all that
the one before it kept.

1. language: documents without a language, or with an unsure one, go.
2. exact_dedup: of documents with equal contents, the one with the largest doc_id stays.
3. near_dedup: of documents that hang together at 80 % of their five-word shingles, the one with the smallest.
4. mix: sources come to their target weights; a document leaves, stays or comes up to three times.
5. pack: tokens of at most 1024 to a sequence, in order, cut where it costs least.
"""

from __future__ import annotations

import os
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import exact_dedup, jaccard_join, language_id, mix_sources, packing
from rankweave.llm.common import checkpoint_dir, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = os.path.join(folder, f"{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
