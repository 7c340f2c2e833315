"""Frames to segments: speed cap, segment numbers, the death trim, metadata and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.params import TrackParams

KEYS = ["entity", "seg"]


def cap_speed(speed: Column, limit: float) -> Column:
    """Upper clip; a missing speed stays missing."""
    return F.when(speed > limit, F.lit(limit)).otherwise(speed)


def segment_number(frame: Column, segment_len: int) -> Column:
    return F.floor((frame - 1) / F.lit(segment_len)).cast("long")


def assign_segments(frames: DataFrame, p: TrackParams) -> DataFrame:
    return frames.withColumns(
        {
            "speed": cap_speed(F.col("speed"), p.max_speed),
            "seg": segment_number(F.col("frame"), p.segment_len),
        }
    )


def trim_at_death(frames: DataFrame, lifespans: DataFrame, p: TrackParams) -> DataFrame:
    """Keep frames of known entities up to and including the segment of death.

    The lookup has one row per entity; whether it is broadcast is left to its measured size.
    """
    last = lifespans.select(
        "entity",
        (F.floor(F.col("seconds") / p.segment_len).cast("long") + 1).alias("death_segment"),
    )
    return frames.join(last, "entity").where(F.col("seg") < F.col("death_segment"))


def segment_metadata(frames: DataFrame) -> DataFrame:
    """One row per segment: identity, death segment, label and frame count."""
    return frames.groupBy(*KEYS).agg(
        F.min("death_segment").alias("death_segment"),
        F.min("label").alias("label"),
        F.count(F.lit(1)).alias("n_frames"),
    )


def track_metadata(frames: DataFrame) -> DataFrame:
    """One row per whole track: death segment, label and frame count."""
    return frames.groupBy("entity").agg(
        F.min("death_segment").alias("death_segment"),
        F.min("label").alias("label"),
        F.count(F.lit(1)).alias("n_frames"),
    )


def coordinate_bounds(frames: DataFrame, entity: str = "entity") -> DataFrame:
    """Smallest and largest position, angle and speed over all files, and the files holding each.

    Where a column has no value at all the fixed defaults ±180 and 0..1 are reported.
    """
    default = {"x": (0.0, 1.0), "y": (0.0, 1.0), "turning_angle": (-180.0, 180.0), "speed": (0.0, 1.0)}
    have = {c: c for c in default if c in frames.columns}
    # one row per file first, so counting files needs no distinct over the frames
    per_file = frames.groupBy(entity).agg(
        *[f(c).alias(f"{n}_{c}") for c in have for n, f in (("min", F.min), ("max", F.max))]
    )
    out = []
    for c, (low, high) in default.items():
        if c in have:
            out += [
                F.coalesce(F.min(f"min_{c}"), F.lit(low)).alias(f"{c}_min"),
                F.coalesce(F.max(f"max_{c}"), F.lit(high)).alias(f"{c}_max"),
            ]
        else:
            out += [F.lit(low).alias(f"{c}_min"), F.lit(high).alias(f"{c}_max")]
    def files(c: str) -> Column:
        return F.count(f"min_{c}") if c in have else F.lit(0).cast("long")

    return per_file.agg(
        *out,
        F.count(F.lit(1)).alias("files"),
        files("x").alias("files_with_xy"),
        files("turning_angle").alias("files_with_angle"),
        files("speed").alias("files_with_speed"),
    )
