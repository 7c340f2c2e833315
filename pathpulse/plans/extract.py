"""Cleaned frames to the 57-feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathpulse.operators import features_native as native
from pathpulse.operators import features_signal as signal
from pathpulse.operators.segments import KEYS
from pathpulse.session import stored
from pathpulse.sources.manifest import absent

FEATURES = (
    native.BASIC + native.TURNING + ["turning_frequency"] + native.MEANDERING + native.ENTROPY
    + native.FRACTAL + signal.WAVELET + signal.ROAMING + native.FRENETIC + native.PHYSICS
    + native.STATISTICAL + native.TEMPORAL + signal.SPECTRUM + native.BEHAVIOR
)


def _extracted(frames: DataFrame, errors: bool, meander_window: int = 30) -> DataFrame:
    parts = [
        native.all_scalar_features(frames),
        native.turning_frequency(frames),
        native.meandering_features(frames, meander_window),
        native.entropy_features(frames),
        native.fractal_features(frames),
        native.frenetic_features(frames),
        native.behavior_features(frames),
        signal.signal_features(
            signal.segment_arrays(frames), "spectrum", "wavelet", "roaming", errors=errors
        ),
    ]
    labels = frames.groupBy(*KEYS).agg(F.min("label").alias("label"))
    joined = reduce(lambda a, b: a.join(b, KEYS, "left"), parts, labels)
    return joined.select(
        *KEYS, "label", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES],
        *(["error"] if errors else []),
    )


def extract_features(frames: DataFrame, meander_window: int = 30) -> DataFrame:
    """One row per segment: ``entity, seg, label`` and 57 features.

    Every family is grouped on ``(entity, seg)``, so the joins find their sides partitioned alike. Segments of fewer
    known positions than ``meander_window`` have no whole window and so no meandering ratio.
    """
    return _extracted(frames, errors=False, meander_window=meander_window)


def with_segment_error(frames: DataFrame) -> DataFrame:
    """Add ``error`` to the frames: why their segment cannot be computed, null where it can."""
    wrong = [F.when(F.abs(c) == float("inf"), f"{c} is not finite") for c in ("speed", "x", "y", "turning_angle")]
    return frames.withColumn("error", F.min(F.coalesce(*wrong)).over(Window.partitionBy(*KEYS)))


def extract_checked(frames: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """As ``extract_features``, with a column ``error``; a segment that fails has a message and null features.

    Segments with infinite values are kept from the feature expressions, and the signal functions report what they
    cannot do, so one bad segment costs no other its row. Of ``listed(entity, seg)``, segments without any
    frame get a row too, with a null label.
    """
    marked = stored(with_segment_error(frames))
    good = _extracted(marked.where("error is null").drop("error"), errors=True)
    good = good.select(
        *KEYS, "label", *[F.when(F.col("error").isNull(), F.col(f)).alias(f) for f in FEATURES], "error"
    )
    none = [F.lit(None).cast("double").alias(f) for f in FEATURES]
    bad = marked.where("error is not null").groupBy(*KEYS).agg(
        F.min("label").alias("label"), F.min("error").alias("error")
    )
    out = good.unionByName(bad.select(*KEYS, "label", *none, "error"))
    if listed is not None:
        missing = absent(listed.select(*KEYS), marked, KEYS)
        out = out.unionByName(
            missing.select(*KEYS, F.lit(None).cast(out.schema["label"].dataType).alias("label"), *none, F.lit("no frames").alias("error"))
        )
    return out
