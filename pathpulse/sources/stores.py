"""Stored tables between the stages: frames, metadata, features, reports and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathpulse.operators.labels import labelled
from pathpulse.operators.resample import sequences, track_chunks
from pathpulse.operators.segments import KEYS
from pathpulse.sources.manifest import absent, read_tolerant, write_manifest

GRAINS = ("segments", "full")


def write_frames(frames: DataFrame, path: str) -> None:
    """Cleaned frames, a folder per label, whole segments together and in frame order.

    One table serves both grains: a full track is its segments in order. A manifest of its files lies beside it.
    """
    (
        frames.repartition(*KEYS)
        .sortWithinPartitions(*KEYS, "frame")
        .write.mode("overwrite")
        .partitionBy("label")
        .parquet(path)
    )
    write_manifest(frames.sparkSession, path)


def read_frames(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Stored frames; ``tolerant`` leaves out files that cannot be read (see ``manifest.stored_report``)."""
    return read_tolerant(spark, path) if tolerant else spark.read.parquet(path)


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", "true").csv(path)


def write_report(one_row: DataFrame, path: str) -> None:
    """Bounds or data info as a JSON line."""
    one_row.write.mode("overwrite").json(path)


def write_analyses(results: dict[str, DataFrame], path: str) -> None:
    """Results of several analyses in one table, a folder per analysis.

    Their columns differ, so each keeps its own below the shared key columns.
    """
    for name, table in results.items():
        table.write.mode("overwrite").parquet(f"{path}/analysis={name}")


def load_features(spark: SparkSession, path: str, grain: str = "segments") -> DataFrame:
    """Feature table of segments or of full tracks."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}; known: {GRAINS}")
    return spark.read.parquet(f"{path}/{grain}_features")


def store_features(table: DataFrame, path: str, grain: str = "segments") -> None:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}; known: {GRAINS}")
    write_table(table, f"{path}/{grain}_features")


def load_labelled_features(
    spark: SparkSession, path: str, labeling: str = "death_proximity", threshold: int = 5
) -> DataFrame:
    """Segment features with the stored label or the last-segments label."""
    if labeling not in ("original", "death_proximity"):
        raise ValueError(f"unknown labeling strategy: {labeling}")
    return labelled(load_features(spark, path), labeling, threshold)


def load_sequences(frames: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences of the listed segments, and the listed segments that have no frames."""
    listed = metadata.select(*KEYS)
    found = sequences(frames.join(listed, KEYS, "left_semi"))
    return found, absent(listed, frames, KEYS)


def load_full_sequences(
    frames: DataFrame, metadata: DataFrame, size: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Chunks of the listed entities' whole tracks, and the listed entities that have no frames."""
    listed = metadata.select("entity").distinct()
    wanted = frames.join(listed, "entity", "left_semi")
    return track_chunks(wanted, size) if size else track_chunks(wanted), absent(listed, frames, ["entity"])


def full_sequence_lengths(chunks: DataFrame) -> DataFrame:
    tracks = chunks.where("chunk = 0")
    return tracks.agg(
        F.min("n_frames").alias("min_length"), F.max("n_frames").alias("max_length"), F.avg("n_frames").alias("mean_length")
    )


def sequence_lengths(found: DataFrame) -> DataFrame:
    return found.agg(
        F.min(F.size("seq")).alias("min_length"),
        F.max(F.size("seq")).alias("max_length"),
        F.avg(F.size("seq")).alias("mean_length"),
    )
