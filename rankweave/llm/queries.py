"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import (collocations, exact_dedup, jaccard_join, language_id, lm_scoring, mix_sources, packing, quality_ranking,
                           quality_rules, secret_scan, toxicity, warc_bundles, whitening)
from rankweave.llm.common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target texts are the documents that labels call good."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(read(spark, sf_dir, "documents"), good)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.warc_round_trip(read(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix_sources(read(spark, sf_dir, "documents"))


def op11_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.quality_ranking(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(read(spark, sf_dir, "embeddings"))


JOBS = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_lm_scoring, op4_quality_rules, op5_packing,
                                op6_secret_scan, op7_warc, op8_language_id, op9_jaccard_join, op10_mix_sources,
                                op11_quality_ranking, op12_collocations, op13_whitening)}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op7_warc": warc_bundles.SQL,
    "op12_collocations": collocations.SQL,
}
