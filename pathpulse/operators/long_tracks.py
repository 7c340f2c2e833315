"""Features of whole tracks of any length.

A track is not gathered in one place. Its rows get a position, and the positions are cut into chunks
that also carry the last few rows of the chunk before, so every difference or filter of short reach
is computed inside a chunk. What depends on the whole track (extremes, quantiles, histogram counts)
is aggregated per entity and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pathpulse.functions.signal import DB4_HIGH, DB4_LOW
from pathpulse.operators import features_native as native
from pathpulse.operators.numbering import group_extremes, number_rows
from pathpulse.operators.ordered import exact_quantiles

CHUNK = 8192
FRAMES_PER_BLOCK = 65_536
ENTITY = ["entity"]
CHANNEL = ["entity", "name"]


def positions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0-based ``pos`` along the track and its length ``n``."""
    block = F.floor(F.col("frame") / F.lit(FRAMES_PER_BLOCK))
    placed = number_rows(rows, keys, ["frame"], block, "pos", total="n")
    return placed.withColumn("pos", F.col("pos") - 1)


def in_chunks(
    placed: DataFrame, reach: int, size: int | None = None
) -> DataFrame:
    """Cut positions into chunks; the last ``reach`` rows of a chunk are repeated before the next."""
    size = size or CHUNK
    chunk = F.floor(F.col("pos") / size)
    both = F.array(
        F.struct(chunk.alias("chunk"), F.lit(False).alias("repeated")),
        F.when(
            F.pmod("pos", F.lit(size)) >= size - reach,
            F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("repeated")),
        ),
    )
    return placed.select("*", F.inline(F.array_compact(both)))


def along(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "chunk").orderBy("pos")


def channel_values(frames: DataFrame) -> DataFrame:
    pair = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.col(column).alias("v"))
            for name, column in (("speed", "speed"), ("turning", "turning_angle"))
        ]
    )
    return frames.select("entity", "frame", F.inline(pair)).where(F.col("v").isNotNull())


def _by_channel(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per entity from one row per entity and channel: ``{output pattern: column}``."""
    return table.groupBy("entity").agg(
        *[
            F.coalesce(F.max(F.when(F.col("name") == name, F.col(column))), F.lit(0.0)).alias(
                pattern.format(name)
            )
            for name in ("speed", "turning")
            for pattern, column in columns.items()
        ]
    )


def moments(frames: DataFrame) -> DataFrame:
    """The features that are plain aggregates of single frames."""
    absent = {c: F.lit(None).cast("double") for c in ("dist", "speed_q25", "speed_q75")}
    groups = (
        native.basic_aggregates(), native.turning_aggregates(), native.physics_aggregates(),
        native.statistical_aggregates(),
    )
    every = {name: column for group in groups for name, column in group.items()}
    for elsewhere in ("total_distance", "speed_iqr"):
        every.pop(elsewhere)
    return (
        frames.withColumns(absent).groupBy("entity").agg(*[c.alias(n) for n, c in every.items()])
    )


def speed_quartile_range(frames: DataFrame) -> DataFrame:
    quartiles = exact_quantiles(frames.select("entity", "speed"), ENTITY, "speed", [0.25, 0.75])
    return quartiles.select("entity", (F.get("q", 1) - F.get("q", 0)).alias("speed_iqr"))


def speed_changes(frames: DataFrame) -> DataFrame:
    """Trend and acceleration along the track."""
    known = frames.where(F.col("speed").isNotNull()).select("entity", "frame", "speed")
    stepped = (
        in_chunks(positions(known, ENTITY), 1)
        .withColumn("accel", F.col("speed") - F.lag("speed").over(along(ENTITY)))
        .where(~F.col("repeated"))
        .withColumn("speed_pos", F.col("pos").cast("double"))
    )
    return stepped.groupBy("entity").agg(
        *[c.alias(n) for n, c in native.temporal_aggregates().items()]
    )


def distance_travelled(frames: DataFrame) -> DataFrame:
    """Sum of steps; each coordinate steps from its own last known value, and a step has both."""
    pair = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("x", "y")])
    known = frames.select("entity", "frame", F.inline(pair)).where(F.col("v").isNotNull())
    stepped = (
        in_chunks(positions(known, CHANNEL), 1)
        .withColumn("step", F.col("v") - F.lag("v").over(along(CHANNEL)))
        .where(~F.col("repeated"))
    )
    dx, dy = (F.max(F.when(F.col("name") == c, F.col("step"))).alias(f"d{c}") for c in ("x", "y"))
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    both = stepped.groupBy("entity", "frame").agg(dx, dy)
    return both.groupBy("entity").agg(F.sum(length).alias("total_distance"))


def path_features(frames: DataFrame, window_size: int = 30) -> DataFrame:
    """Meandering in whole windows of known positions."""
    known = frames.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        "entity", "frame", "x", "y"
    )
    track = along(ENTITY)
    dx, dy = F.col("x") - F.lag("x").over(track), F.col("y") - F.lag("y").over(track)
    stepped = (
        in_chunks(positions(known, ENTITY), 1)
        .withColumn("dist", F.sqrt(dx * dx + dy * dy))
        .where(~F.col("repeated"))
    )
    first, last = F.min_by(F.struct("x", "y"), "pos"), F.max_by(F.struct("x", "y"), "pos")
    wide, high = last["x"] - first["x"], last["y"] - first["y"]
    windows = (
        stepped.withColumn("win", F.floor(F.col("pos") / window_size))
        .groupBy("entity", "win")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("pos") % window_size > 0, F.col("dist"))).alias("path"),
            F.sqrt(wide * wide + high * high).alias("net"),
        )
        .withColumn(
            "ratio",
            F.when(
                (F.col("n") == window_size) & (F.col("path") > 0), F.col("net") / F.col("path")
            ),
        )
    )
    medians = exact_quantiles(windows.select("entity", "ratio"), ENTITY, "ratio", [0.5])
    summed = windows.groupBy("entity").agg(
        F.avg("ratio").alias("mean_meandering_ratio"),
        F.stddev_pop("ratio").alias("std_meandering_ratio"),
        F.min("ratio").alias("min_meandering_ratio"),
        F.max("ratio").alias("max_meandering_ratio"),
        F.avg((F.col("ratio") > 0.5).cast("double")).alias("fraction_efficient_movement"),
    )
    return summed.join(
        medians.select("entity", F.get("q", 0).alias("median_meandering_ratio")), "entity", "left"
    )


def turning_frequency(frames: DataFrame, height: float = 90) -> DataFrame:
    """Peaks of the absolute angle; runs of equal angles are reduced to one row and renumbered."""
    angle = F.col("angle")
    known = frames.where(F.col("turning_angle").isNotNull()).select(
        "entity", "frame", F.abs(native.even_angle()).alias("angle")
    )
    sizes = known.groupBy("entity").agg(F.count(F.lit(1)).alias("n_known"))
    before = F.lag("angle").over(along(ENTITY))
    runs = (
        in_chunks(positions(known, ENTITY), 1)
        .withColumn("prior", before)
        .where(~F.col("repeated") & (F.col("prior").isNull() | (angle != F.col("prior"))))
        .select("entity", "frame", "angle")
    )
    # a peak is recognised from the row after it
    middle, left = F.lag("angle").over(along(ENTITY)), F.lag("angle", 2).over(along(ENTITY))
    peaks = (
        in_chunks(positions(runs, ENTITY), 2)
        .withColumn("peak", (middle > left) & (middle > angle) & (middle >= height))
        .where(~F.col("repeated") & F.col("peak"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("peaks"))
    )
    return sizes.join(peaks, "entity", "left").select(
        "entity", (F.coalesce("peaks", F.lit(0)) / F.col("n_known")).alias("turning_frequency")
    )


def entropy_features(frames: DataFrame, bins: int = 20) -> DataFrame:
    values = channel_values(frames)
    ranged = group_extremes(values, CHANNEL, low=F.min("v"), high=F.max("v"))
    binned = native.with_histogram_bin(ranged, "v", F.col("low"), F.col("high"), bins)
    counts = binned.groupBy(*CHANNEL, "bin").agg(F.count(F.lit(1)).alias("c"))
    entropy = F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")
    return _by_channel(counts.groupBy(*CHANNEL).agg(entropy.alias("e")), {"{}_entropy": "e"})


def fractal_features(frames: DataFrame, k_max: int = 10) -> DataFrame:
    track = along(CHANNEL)
    placed = in_chunks(
        positions(channel_values(frames), CHANNEL).where(F.col("n") >= 2 * k_max), k_max
    )
    stepped = placed.withColumns(
        {f"d{k}": native.move(F.col("v"), F.lag("v", k).over(track)) for k in range(1, k_max + 1)}
    ).where(~F.col("repeated"))
    slopes = native.curve_length_slopes(stepped, CHANNEL, k_max)
    return _by_channel(slopes, {"{}_fractal_dim": "slope"})


def frenetic_features(frames: DataFrame, window_size: int = 10, overlap: int = 5) -> DataFrame:
    track = along(ENTITY)
    known = frames.where(F.col("speed").isNotNull() & F.col("turning_angle").isNotNull()).select(
        "entity", "frame", "speed", "turning_angle"
    )
    stepped = (
        in_chunks(positions(known, ENTITY), 2)
        .withColumns(
            {
                "accel": F.col("speed") - F.lag("speed").over(track),
                "turn": F.abs(F.col("turning_angle") - F.lag("turning_angle").over(track)),
                "accel_before": F.lag("speed").over(track) - F.lag("speed", 2).over(track),
            }
        )
        .where(~F.col("repeated"))
    )
    windows = native.frenetic_windows(stepped, ENTITY, window_size, window_size - overlap)
    limits = exact_quantiles(windows.select("entity", "score"), ENTITY, "score", [0.75]).select(
        "entity", F.get("q", 0).alias("limit")
    )
    scored = windows.join(limits, "entity", "left").groupBy("entity").agg(
        F.avg("score").alias("mean_frenetic_score"),
        F.max("score").alias("max_frenetic_score"),
        F.stddev_pop("score").alias("std_frenetic_score"),
        F.count("score").alias("scores"),
        F.count_if(F.col("score") > F.col("limit")).alias("above"),
        F.avg("jerk").alias("mean_jerk"),
        F.max("jerk").alias("max_jerk"),
    )
    share = F.when(F.col("scores") >= 4, F.col("above") / F.col("scores"))
    return scored.withColumn("pct_high_frenetic", share).drop("scores", "above")


def behavior_features(frames: DataFrame) -> DataFrame:
    rows = frames.select("entity", "speed", F.abs("turning_angle").alias("turn"))
    topped = group_extremes(rows, ENTITY, top_speed=F.max("speed"), top_turn=F.max("turn"))
    score = 0.7 * F.col("speed") / (F.col("top_speed") + native.SMALL) + 0.3 * F.col("turn") / (
        F.col("top_turn") + native.SMALL
    )
    scored = topped.select("entity", score.alias("score")).where(F.col("score").isNotNull())
    cuts = exact_quantiles(scored, ENTITY, "score", [0.25, 0.75]).select(
        "entity", F.get("q", 0).alias("low"), F.get("q", 1).alias("high")
    )
    s = F.col("score")
    return scored.join(cuts, "entity").groupBy("entity").agg(
        F.avg(s).alias("activity_level"),
        F.avg((s > F.col("high")).cast("double")).alias("high_activity_fraction"),
        F.avg((s < F.col("low")).cast("double")).alias("low_activity_fraction"),
        F.avg(s.between(F.col("low"), F.col("high")).cast("double")).alias(
            "mixed_activity_fraction"
        ),
    )


def mirrored(placed: DataFrame, reach: int) -> DataFrame:
    """Continue a signal by ``reach`` mirrored values on both sides; positions then start at 0.

    Signals shorter than ``reach`` are mirrored repeatedly.
    """
    period = 2 * F.col("n")
    turns = F.sequence(F.lit(-reach), F.lit(reach))
    near = F.array_distinct(
        F.concat(
            F.array(F.col("pos"), -1 - F.col("pos"), period - 1 - F.col("pos")),
            F.when(
                F.col("n") < reach,
                F.flatten(
                    F.transform(
                        turns, lambda q: F.array(F.col("pos") + period * q, period * q - 1 - F.col("pos"))
                    )
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    )
    wanted = F.filter(near, lambda i: (i >= -reach) & (i < F.col("n") + reach))
    columns = [c for c in placed.columns if c != "pos"]
    return placed.select(*columns, F.explode(wanted).alias("_at")).select(
        *columns, (F.col("_at") + reach).alias("pos")
    )


def _filtered(taps: Sequence[float], column: str, window: WindowSpec) -> Column:
    """Sum of the last values weighted by ``taps``, newest first."""
    return sum(
        (float(w) * (F.lag(column, t).over(window) if t else F.col(column)) for t, w in enumerate(taps)),
        F.lit(0.0),
    )


def wavelet_features(frames: DataFrame, max_level: int = 3) -> DataFrame:
    """Spread of the wavelet bands, level by level; each level halves the signal."""
    reach = len(DB4_LOW) - 1
    placed = positions(channel_values(frames), CHANNEL).where(F.col("n") >= 4)
    deepest = F.least(F.lit(max_level), F.floor(F.log2("n").cast("double") + 1e-12) - 1)
    signal = placed.withColumn("levels", deepest).where("levels > 0").select(
        *CHANNEL, "pos", "n", "v", "levels"
    )
    bands = []
    for level in range(1, max_level + 1):
        window = along(CHANNEL)
        filtered = (
            in_chunks(mirrored(signal, reach), reach)
            .withColumns(
                {"a": _filtered(DB4_LOW, "v", window), "d": _filtered(DB4_HIGH, "v", window)}
            )
            .where(~F.col("repeated") & (F.col("pos") >= reach + 1))
            .where((F.col("pos") - reach) % 2 == 1)
        )
        kept = filtered.select(
            *CHANNEL, ((F.col("pos") - reach - 1) / 2).cast("long").alias("pos"),
            F.floor((F.col("n") + reach) / 2).alias("n"), "a", "d", "levels",
        )
        spread = kept.groupBy(*CHANNEL, "levels").agg(
            F.stddev_pop("d").alias("detail"), F.stddev_pop("a").alias("rest")
        )
        bands.append(
            spread.select(
                *CHANNEL, (F.col("levels") - level + 1).alias("band"), F.col("detail").alias("s")
            )
        )
        bands.append(
            spread.where(F.col("levels") == level).select(
                *CHANNEL, F.lit(0).cast("long").alias("band"), F.col("rest").alias("s")
            )
        )
        signal = kept.where(F.col("levels") > level).select(
            *CHANNEL, "pos", "n", F.col("a").alias("v"), "levels"
        )
    table = bands[0]
    for band in bands[1:]:
        table = table.unionByName(band)
    wide = table.groupBy(*CHANNEL).agg(
        *[
            F.max(F.when(F.col("band") == b, F.col("s"))).alias(f"b{b}")
            for b in range(max_level + 1)
        ]
    )
    return _by_channel(wide, {f"wavelet_{{}}_level{b}": f"b{b}" for b in range(max_level + 1)})


def roaming_features(
    frames: DataFrame, window_size: int = 30, sigma: float = 3.0, radius: int = 12,
    angle_scale: float = 180.0,
) -> DataFrame:
    """Smoothed speed against smoothed turning in whole windows."""
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps = (taps / taps.sum()).tolist()
    window = along(CHANNEL)
    placed = positions(channel_values(frames), CHANNEL).where(F.col("n") >= window_size)
    smooth = (
        in_chunks(mirrored(placed, radius), 2 * radius)
        .withColumn("s", _filtered(taps, "v", window))
        .where(~F.col("repeated") & (F.col("pos") >= 2 * radius))
        .withColumn("win", F.floor((F.col("pos") - 2 * radius) / window_size))
    )
    speed = F.when(F.col("name") == "speed", F.col("s"))
    turning = F.when(F.col("name") == "turning", F.abs("s"))
    windows = (
        smooth.groupBy("entity", "win")
        .agg(
            F.avg(speed).alias("a"), F.avg(turning).alias("b"),
            F.count(speed).alias("na"), F.count(turning).alias("nb"),
        )
        .where((F.col("na") == window_size) & (F.col("nb") == window_size))
        .withColumn("score", (F.col("a") - F.col("b") / angle_scale) / 2)
    )
    return windows.groupBy("entity").agg(
        F.avg("score").alias("mean_roaming_score"),
        F.stddev_pop("score").alias("std_roaming_score"),
        F.avg((F.col("score") > 0).cast("double")).alias("fraction_roaming"),
    )
