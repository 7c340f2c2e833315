"""Queries of the corpus operators over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathpulse.llm.decontaminate import contaminated
from pathpulse.llm.language import languages
from pathpulse.llm.lines import without_matched_lines, without_matched_lines_sql
from pathpulse.llm.minhash import MinHash, near_duplicates
from pathpulse.llm.mixing import mixture_digest, mixture_sql
from pathpulse.llm.negatives import hard_negative_digest, hard_negative_sql
from pathpulse.llm.packing import pack
from pathpulse.llm.personal import personal_data
from pathpulse.llm.pitman_yor import language_scores
from pathpulse.llm.quality import quality_scores
from pathpulse.llm.rules import quality_rules, quality_rules_sql
from pathpulse.llm.tokens import token_counts
from pathpulse.llm.whitening import whitened_components
from pathpulse.sources.tables import read_table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def op1_positive_unlabelled_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_documents(spark, folder), read_table(spark, folder, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_documents(spark, folder), MinHash(shingle=2))


def op3_adaptive_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_documents(spark, folder))


def op4_hyperdimensional_language(spark: SparkSession, folder: str) -> DataFrame:
    return languages(_documents(spark, folder))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_matched_lines(_documents(spark, folder)).select("doc_id", "text", "n_lines", "n_removed")


def op6_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_documents(spark, folder))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_documents(spark, folder))


def op8_spaced_seed_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_documents(spark, folder), read_table(spark, folder, "benchmark"))


def op9_pitman_yor_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_scores(_documents(spark, folder))


def op10_skip_chain_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(_documents(spark, folder))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_components(read_table(spark, folder, "embeddings"))


def op12_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_digest(_documents(spark, folder))


def op13_cover_tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negative_digest(read_table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_positive_unlabelled_quality,
        op2_minhash_near_dedup,
        op3_adaptive_quality_rules,
        op4_hyperdimensional_language,
        op5_line_dedup,
        op6_mixture_packing,
        op7_token_counts,
        op8_spaced_seed_decontamination,
        op9_pitman_yor_scores,
        op10_skip_chain_personal_data,
        op11_embedding_whitening,
        op12_source_mixing,
        op13_cover_tree_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op3_adaptive_quality_rules": quality_rules_sql(),
    "op5_line_dedup": without_matched_lines_sql(),
    "op12_source_mixing": mixture_sql(),
    "op13_cover_tree_negatives": hard_negative_sql(),
}
