"""Repair of missing positions inside a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pathpulse.operators.segments import KEYS
from pathpulse.params import TrackParams

CHANNELS = ("x", "y", "speed")


def forward() -> WindowSpec:
    """A segment in frame order."""
    return Window.partitionBy(*KEYS).orderBy("frame")


def passed() -> WindowSpec:
    return forward().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead() -> WindowSpec:
    """Running scan from the segment's end, so that looking forward also costs one pass."""
    backward = Window.partitionBy(*KEYS).orderBy(F.col("frame").desc())
    return backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _known(channel: str) -> Column:
    return F.when(F.col(channel).isNotNull(), F.struct("frame", F.col(channel).alias("v")))


def mark_gaps(frames: DataFrame) -> DataFrame:
    """Add ``gap_start``, ``gap_end`` and ``gap_len``; null on rows whose x is known.

    Also leaves the nearest known value of each channel on either side for the repair.
    """
    frames = frames.withColumns(
        {f"next_{c}": F.last(_known(c), ignorenulls=True).over(ahead()) for c in CHANNELS}
        | {"seg_end": F.first("frame").over(ahead())}
    ).withColumns(
        {f"prev_{c}": F.last(_known(c), ignorenulls=True).over(passed()) for c in CHANNELS}
        | {"seg_start": F.first("frame").over(passed())}
    )
    in_gap = F.col("x").isNull()
    return frames.withColumns(
        {
            "gap_start": F.when(
                in_gap, F.coalesce(F.col("prev_x.frame") + 1, F.col("seg_start"))
            ),
            "gap_end": F.when(in_gap, F.coalesce(F.col("next_x.frame") - 1, F.col("seg_end"))),
        }
    ).withColumn("gap_len", F.col("gap_end") - F.col("gap_start") + 1)


def _filled(channel: str) -> Column:
    """Line between the neighbours within one frame of the gap; a missing right one repeats the left."""
    prev, nxt = F.col(f"prev_{channel}"), F.col(f"next_{channel}")
    has_prev = prev["frame"] >= F.col("gap_start") - 1
    has_next = nxt["frame"] <= F.col("gap_end") + 1
    share = (F.col("frame") - prev["frame"]) / (nxt["frame"] - prev["frame"])
    return (
        F.when(F.col(channel).isNotNull(), F.col(channel))
        .when(has_prev & has_next, prev["v"] + (nxt["v"] - prev["v"]) * share)
        .when(has_prev, prev["v"])
    )


def repair_gaps(frames: DataFrame, p: TrackParams) -> DataFrame:
    """Interpolate short gaps and drop long ones; gaps in between stay missing."""
    marked = mark_gaps(frames)
    short = F.col("gap_len") <= p.interp_limit
    repaired = marked.withColumns(
        {c: F.when(short, _filled(c)).otherwise(F.col(c)) for c in CHANNELS}
    )
    kept = repaired.where(F.col("gap_len").isNull() | (F.col("gap_len") < p.long_gap))
    return kept.drop(
        "seg_start", "seg_end", "gap_start", "gap_end", "gap_len",
        *[f"{side}_{c}" for side in ("prev", "next") for c in CHANNELS],
    )
