"""Segment features that need a transform of the whole segment: one array per channel and segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.functions.signal import (
    smoothed,
    spectrum_summary,
    wavelet_bands,
)
from pathpulse.operators.segments import KEYS

SPECTRUM = """speed_dominant_freq speed_spectral_centroid turning_dominant_freq
    turning_spectral_centroid""".split()
WAVELET = [f"wavelet_{c}_level{i}" for c in ("speed", "turning") for i in range(4)]
ROAMING = ["mean_roaming_score", "std_roaming_score", "fraction_roaming"]


def segment_arrays(frames: DataFrame) -> DataFrame:
    """Known speeds and turning angles of each segment in frame order (a segment is bounded)."""

    def ordered(channel: str) -> Column:
        pairs = F.collect_list(
            F.when(F.col(channel).isNotNull(), F.struct("frame", F.col(channel).alias("v")))
        )
        return F.transform(F.array_sort(pairs), lambda p: p["v"])

    return frames.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_frames"),
        ordered("speed").alias("speed"),
        ordered("turning_angle").alias("turning"),
    )


def signal_features(arrays: DataFrame, *families: str, errors: bool = False) -> DataFrame:
    """Families among ``spectrum wavelet roaming``; all share one Arrow exchange.

    With ``errors`` a column ``error`` holds the first message of a segment that failed, else null.
    """
    work = {}
    for channel in ("speed", "turning"):
        if "spectrum" in families:
            work[f"{channel}_s"] = spectrum_summary(channel)
        if "wavelet" in families:
            work[f"{channel}_w"] = wavelet_bands(channel)
        if "roaming" in families:
            work[f"{channel}_r"] = smoothed(channel)
    out = arrays.withColumns(work)
    if "roaming" in families:
        out = out.withColumns({f"{c}_g": F.col(f"{c}_r.values") for c in ("speed", "turning")})
    names: list[str] = []
    extra: dict[str, Column] = {}
    if "spectrum" in families:
        for channel in ("speed", "turning"):
            extra[f"{channel}_dominant_freq"] = F.col(f"{channel}_s.strongest")
            extra[f"{channel}_spectral_centroid"] = F.col(f"{channel}_s.centroid")
        names += SPECTRUM
    if "wavelet" in families:
        for channel in ("speed", "turning"):
            for i in range(4):
                extra[f"wavelet_{channel}_level{i}"] = F.get(f"{channel}_w.values", i)
        names += WAVELET
    if "roaming" in families:
        extra |= roaming_columns()
        names += ROAMING
    if errors:
        extra["error"] = F.coalesce(*[F.col(f"{name}.error") for name in work])
        names = [*names, "error"]
    return out.withColumns(extra).select(*KEYS, *names)


def roaming_columns(window_size: int = 30, angle_scale: float = 180.0) -> dict[str, Column]:
    """Mean smoothed speed against mean smoothed turning in whole windows; above 0 is roaming."""
    usable = F.least(F.size("speed_g"), F.size("turning_g"))
    windows = F.floor(usable / window_size).cast("int")

    def window_mean(channel: str, i: Column, absolute: bool) -> Column:
        part = F.slice(F.col(channel), i * window_size + 1, window_size)
        return F.aggregate(
            part, F.lit(0.0), lambda a, v: a + (F.abs(v) if absolute else v)
        ) / F.lit(window_size)

    scores = F.transform(
        F.sequence(F.lit(0), windows - 1),
        lambda i: (
            window_mean("speed_g", i, False) - window_mean("turning_g", i, True) / angle_scale
        )
        / 2,
    )
    scores = F.when(windows >= 1, scores).otherwise(F.array().cast("array<double>"))
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v) / n
    spread = F.sqrt(
        F.aggregate(scores, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    )
    return {
        "mean_roaming_score": F.when(n > 0, mean).otherwise(0.0),
        "std_roaming_score": F.when(n > 0, spread).otherwise(0.0),
        "fraction_roaming": F.when(
            n > 0, F.size(F.filter(scores, lambda v: v > 0)) / n
        ).otherwise(0.0),
    }
