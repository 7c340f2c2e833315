"""Turning angles and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.operators.gaps import forward
from pathpulse.params import TrackParams


def wrap_degrees(radians: Column) -> Column:
    """Angle in degrees within [-180, 180)."""
    return F.degrees(F.pmod(radians + F.pi(), 2 * F.pi()) - F.pi())


def turning_angles(frames: DataFrame) -> DataFrame:
    """Change of heading at each frame in degrees; the first and last frame of a segment get 0."""
    before = [F.lag(c).over(forward()) for c in ("x", "y")]
    after = [F.lead(c).over(forward()) for c in ("x", "y")]
    heading_in = F.atan2(F.col("y") - before[1], F.col("x") - before[0])
    heading_out = F.atan2(after[1] - F.col("y"), after[0] - F.col("x"))
    at_edge = F.lag("frame").over(forward()).isNull() | F.lead("frame").over(forward()).isNull()
    return frames.withColumn(
        "turning_angle", F.when(at_edge, F.lit(0.0)).otherwise(wrap_degrees(heading_out - heading_in))
    )


def normalize(frames: DataFrame, p: TrackParams) -> DataFrame:
    """Scale positions to [0, 1] and angles to [-1, 1]; speed keeps its unit."""
    span = p.xy_max - p.xy_min
    return frames.withColumns(
        {c: (F.col(c) - p.xy_min) / span for c in ("x", "y")}
        | {"turning_angle": F.col("turning_angle") / p.angle_max}
    )
