"""Whole runs from files to stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathpulse.functions.filenames import lookup_key
from pathpulse.operators.describe import class_counts
from pathpulse.operators.segments import KEYS, coordinate_bounds, segment_metadata, track_metadata
from pathpulse.params import TrackParams
from pathpulse.plans.extract import extract_checked, with_segment_error
from pathpulse.plans.full_extract import extract_full_features
from pathpulse.plans.preprocess import clean_tracks
from pathpulse.sources import stores, track_files


def preprocess_folder(
    spark: SparkSession, folder: str, lifespan_csv: str, out: str, p: TrackParams = TrackParams()
) -> DataFrame:
    """Track files to the stored frame and metadata tables; returns segments per label."""
    tracks = track_files.scan_tracks(spark, folder)
    frames = track_files.frames_of(tracks)
    stores.write_table(track_files.scan_report(spark, folder), f"{out}/scan_report")
    stores.write_table(track_files.file_dimension(tracks), f"{out}/files")
    spans = track_files.read_lifespans(spark, lifespan_csv)
    entities = frames.groupBy("entity").agg(F.min(lookup_key(F.col("path"))).alias("key"))
    lifespans = entities.join(spans, "key").select("entity", "seconds")
    stores.write_frames(clean_tracks(frames, p, lifespans), f"{out}/frames")
    stored = stores.read_frames(spark, f"{out}/frames")
    files = spark.read.parquet(f"{out}/files")
    stores.write_table(track_files.with_file_identity(segment_metadata(stored), files), f"{out}/metadata")
    stores.write_table(track_files.with_file_identity(track_metadata(stored), files), f"{out}/full_metadata")
    stores.write_report(coordinate_bounds(stored), f"{out}/bounds")
    return class_counts(spark.read.parquet(f"{out}/metadata"))


def extract_stored(spark: SparkSession, out: str) -> DataFrame:
    """Stored frames to the feature tables of both grains; returns the segments that gave no features, and why.

    Frame files that cannot be read are left out here and named by ``manifest.stored_report``.
    """
    frames = stores.read_frames(spark, f"{out}/frames", tolerant=True)
    listed, files = spark.read.parquet(f"{out}/metadata"), spark.read.parquet(f"{out}/files")
    stores.write_table(extract_checked(frames, listed), f"{out}/segments_checked")
    checked = spark.read.parquet(f"{out}/segments_checked")
    good = checked.where("error is null").drop("error")
    stores.store_features(track_files.with_file_identity(good, files), out, "segments")
    stores.write_table(checked.where("error is not null").select(*KEYS, "error"), f"{out}/segments_errors")
    whole = with_segment_error(frames).where("error is null").drop("error")
    stores.store_features(track_files.with_file_identity(extract_full_features(whole), files), out, "full")
    return spark.read.parquet(f"{out}/segments_errors")
