"""Frames as fixed-length multichannel sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.operators.long_tracks import CHUNK, positions
from pathpulse.operators.segments import KEYS

CHANNELS = ("x", "y", "speed", "turning_angle")


def _point() -> Column:
    """The channels of a frame; missing values become 0."""
    return F.struct(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in CHANNELS])


def sequences(frames: DataFrame) -> DataFrame:
    """One array of channel structs per segment in frame order; missing values become 0."""
    points = F.array_sort(F.collect_list(F.struct("frame", _point().alias("p"))))
    return frames.groupBy(*KEYS).agg(
        F.min("label").alias("label"), F.transform(points, lambda e: e["p"]).alias("seq")
    )


def fixed_length(seq: Column, length: int) -> Column:
    """Evenly spaced points of a long sequence; a short one is padded with zeros at its end."""
    n = F.size(seq)
    step = (n - 1) / F.lit(float(length - 1))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in CHANNELS])
    picked = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.get(
            seq, F.when(i == length - 1, n - 1).otherwise(F.floor(i * step).cast("int"))
        ),
    )
    padded = F.concat(seq, F.array_repeat(zero, F.greatest(F.lit(length) - n, F.lit(0))))
    return F.when(n >= length, picked).otherwise(padded)


def resampled_sequences(frames: DataFrame, length: int = 300) -> DataFrame:
    made = sequences(frames)
    return made.withColumn("seq", fixed_length(F.col("seq"), length))


def track_chunks(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """Whole tracks as ``(entity, label, chunk, start, n_frames, seq)``: arrays of at most ``size`` frames in order.

    ``start`` is the 0-based place of a chunk's first frame and ``n_frames`` the length of the track, so a reader can
    walk a track of any length chunk by chunk and no task ever holds more of it than one chunk.
    """
    placed = positions(frames.select("entity", "label", "frame", _point().alias("p")), ["entity"])
    points = F.array_sort(F.collect_list(F.struct("pos", "p")))
    return (
        placed.withColumn("chunk", F.floor(F.col("pos") / size))
        .groupBy("entity", "chunk")
        .agg(
            F.min("label").alias("label"), F.min("pos").alias("start"), F.first("n").alias("n_frames"),
            F.transform(points, lambda e: e["p"]).alias("seq"),
        )
        .select("entity", "label", "chunk", "start", "n_frames", "seq")
    )


def resampled_tracks(frames: DataFrame, length: int = 300) -> DataFrame:
    """Whole tracks at ``length`` evenly spaced points, padded with zeros at the end of a short one.

    A row knows from its place which points it stands for, so only those points of a track are gathered.
    """
    placed = positions(frames.select("entity", "label", "frame", _point().alias("p")), ["entity"])
    step = (F.col("n") - 1) / F.lit(float(length - 1))
    guess = F.ceil(F.col("pos") / F.greatest(step, F.lit(1.0))).cast("int")
    # where rounding moves the guess, a neighbour is the point
    near = F.array(guess - 1, guess, guess + 1)
    at = F.filter(
        near,
        lambda i: (i >= 0) & (i < length)
        & (F.when(i == length - 1, F.col("n") - 1).otherwise(F.floor(i * step)) == F.col("pos")),
    )
    chosen = F.when(F.col("n") >= length, at).otherwise(F.array(F.col("pos").cast("int")))
    points = placed.select("entity", "label", "n", F.explode(chosen).alias("at"), "p")
    gathered = points.groupBy("entity").agg(
        F.min("label").alias("label"), F.first("n").alias("n_frames"),
        F.array_sort(F.collect_list(F.struct("at", "p"))).alias("points"),
    )
    zero = F.struct(*[F.lit(0.0).alias(c) for c in CHANNELS])
    seq = F.concat(
        F.transform("points", lambda e: e["p"]),
        F.array_repeat(zero, F.greatest(F.lit(length) - F.size("points"), F.lit(0))),
    )
    return gathered.select("entity", "label", "n_frames", seq.alias("seq"))


def flattened(seq: str = "seq") -> Column:
    """Channel values of a sequence one after the other, as model input."""
    return F.flatten(F.transform(seq, lambda p: F.array(*[p[c] for c in CHANNELS])))
