"""The corpus pipeline: quality, line deduplication, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathpulse.llm.decontaminate import decontaminated
from pathpulse.llm.lines import without_matched_lines
from pathpulse.llm.minhash import MinHash, near_duplicates
from pathpulse.llm.packing import pack
from pathpulse.llm.quality import quality_kept
from pathpulse.llm.store import keep
from pathpulse.sources.tables import read_table

#: Up to so many rows of ids to drop are broadcast to the documents; more are joined.
MOST_BROADCAST = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3."""
    return quality_kept(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; a document that loses all its words goes."""
    clean = without_matched_lines(docs)
    had = F.col("n_removed") > 0
    clean = clean.where(~had | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(had, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates over five-word shingles: the one of the smallest id."""
    gone = keep(near_duplicates(docs, MinHash()).where("not kept").select("doc_id").distinct())
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens, with their ids."""
    return pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fitted weights and a tokenizer decide the rows, which SQL cannot express; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``; every stage before is stored and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
