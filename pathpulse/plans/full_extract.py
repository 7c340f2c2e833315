"""Cleaned frames to one feature row per whole track."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.operators import long_tracks
from pathpulse.operators.long_spectrum import spectrum_features
from pathpulse.plans.extract import FEATURES


def extract_full_features(frames: DataFrame) -> DataFrame:
    """The 57 features over each entity's whole track: ``entity, label`` and the features.

    Pass a stored table: every family reads it. Tracks may be of any length.
    """
    parts = [
        long_tracks.moments(frames),
        long_tracks.speed_quartile_range(frames),
        long_tracks.speed_changes(frames),
        long_tracks.distance_travelled(frames),
        long_tracks.path_features(frames),
        long_tracks.turning_frequency(frames),
        long_tracks.entropy_features(frames),
        long_tracks.fractal_features(frames),
        long_tracks.frenetic_features(frames),
        long_tracks.behavior_features(frames),
        long_tracks.wavelet_features(frames),
        long_tracks.roaming_features(frames),
        spectrum_features(frames),
    ]
    labels = frames.groupBy("entity").agg(F.min("label").alias("label"))
    joined = reduce(lambda a, b: a.join(b, "entity", "left"), parts, labels)
    return joined.select(
        "entity", "label", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]
    )
