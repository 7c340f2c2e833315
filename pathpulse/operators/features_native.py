"""Segment features made of built-in aggregates and windows over ``(entity, seg)``.

Input: cleaned frames ``entity, seg, frame, speed, x, y, turning_angle``. Every function returns one
row per segment. Missing values are skipped per channel; a feature without enough data is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pathpulse.operators.gaps import forward, passed
from pathpulse.operators.segments import KEYS

BASIC = "mean_speed std_speed max_speed min_speed total_distance time_paused fraction_paused".split()
TURNING = "mean_turning_angle std_turning_angle max_turning_angle".split()
MEANDERING = """mean_meandering_ratio std_meandering_ratio min_meandering_ratio max_meandering_ratio
    median_meandering_ratio fraction_efficient_movement""".split()
PHYSICS = "kinetic_energy_proxy movement_efficiency speed_persistence exploration_ratio".split()
STATISTICAL = "speed_skewness speed_kurtosis speed_iqr speed_cv".split()
TEMPORAL = "speed_trend speed_acceleration_mean speed_acceleration_std".split()
FRACTAL = ["speed_fractal_dim", "turning_fractal_dim"]
ENTROPY = "speed_entropy turning_entropy".split()
FRENETIC = """mean_frenetic_score max_frenetic_score std_frenetic_score pct_high_frenetic
    mean_jerk max_jerk""".split()
BEHAVIOR = """activity_level high_activity_fraction low_activity_fraction
    mixed_activity_fraction""".split()

SMALL = 1e-6
#: Decimals of an angle that mean something; what lies below is the rounding of its arctangents.
ANGLE_DIGITS = 9


def even_angle(angle: Column | str = "turning_angle") -> Column:
    """An angle without its rounding errors, so that mirrored turns are equal."""
    return F.round(angle, ANGLE_DIGITS)


def move(now: Column, before: Column) -> Column:
    """How far a signal moved; a move that is only rounding error, as along a straight line, is none."""
    far = F.abs(now - before)
    return F.when(far < 10.0**-ANGLE_DIGITS, F.lit(0.0)).otherwise(far)


def earlier() -> WindowSpec:
    return forward().rowsBetween(Window.unboundedPreceding, -1)


def segment() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def _zero(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0))


def _step(channel: str) -> Column:
    """Difference to the last known value of the channel."""
    return F.col(channel) - F.last(channel, ignorenulls=True).over(earlier())


def with_steps(frames: DataFrame) -> DataFrame:
    """Per-frame columns shared by the scalar features."""
    return frames.withColumns(
        {
            "dx": _step("x"),
            "dy": _step("y"),
            "accel": _step("speed"),
            "speed_pos": F.when(
                F.col("speed").isNotNull(), F.count("speed").over(passed()) - 1
            ).cast("double"),
        }
    ).withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def _present(*channels: str) -> Column:
    out = F.lit(True)
    for c in channels:
        out = out & (F.count(c) > 0)
    return out


def basic_aggregates(speed_threshold: float = 0.05) -> dict[str, Column]:
    ok = _present("speed", "x", "y")
    paused = F.count_if(F.col("speed") < speed_threshold)
    raw = {
        "mean_speed": F.avg("speed"),
        "std_speed": F.stddev("speed"),
        "max_speed": F.max("speed"),
        "min_speed": F.min("speed"),
        "total_distance": F.sum("dist"),
        "time_paused": paused,
        "fraction_paused": F.try_divide(paused, F.count("speed")),
    }
    return {name: _zero(F.when(ok, c)) for name, c in raw.items()}


def turning_aggregates() -> dict[str, Column]:
    ok = _present("turning_angle", "x", "y")
    raw = {
        "mean_turning_angle": F.avg("turning_angle"),
        "std_turning_angle": F.stddev("turning_angle"),
        "max_turning_angle": F.max(F.abs("turning_angle")),
    }
    return {name: _zero(F.when(ok, c)) for name, c in raw.items()}


def physics_aggregates(turn_threshold: float = 30) -> dict[str, Column]:
    speed, n = F.col("speed"), F.count("speed")
    std = F.stddev("speed")
    turns = F.try_divide(
        F.count_if(F.abs("turning_angle") > turn_threshold), F.count("turning_angle")
    )
    raw = {
        "kinetic_energy_proxy": F.avg(speed * speed / 2),
        "movement_efficiency": F.sum("speed") / (F.max("speed") * n + SMALL),
        "speed_persistence": F.when(std != 0, F.avg("speed") / (std + SMALL)),
        "exploration_ratio": turns / (F.avg("speed") + SMALL),
    }
    return {name: _zero(F.when(n > 0, c)) for name, c in raw.items()}


def statistical_aggregates() -> dict[str, Column]:
    n, std = F.count("speed"), F.stddev("speed")
    spread = (n > 2) & (std != 0)
    raw = {
        "speed_skewness": F.when(spread, F.skewness("speed")),
        "speed_kurtosis": F.when(spread, F.kurtosis("speed")),
        "speed_iqr": F.max("speed_q75") - F.max("speed_q25"),
        "speed_cv": F.when(std != 0, std / (F.avg("speed") + SMALL)),
    }
    return {name: _zero(c) for name, c in raw.items()}


def with_speed_quartiles(frames: DataFrame) -> DataFrame:
    """Speed quartiles of the segment on its frames, by linear interpolation between ranks.

    Ranks keep the aggregation in generated code; the quantile aggregate would leave it.
    """
    ranked = frames.withColumns(
        {
            "_rank": F.row_number().over(
                Window.partitionBy(*KEYS).orderBy(F.col("speed").asc_nulls_last())
            ),
            "_n": F.count("speed").over(segment()),
        }
    )
    columns = {}
    for name, p in (("speed_q25", 0.25), ("speed_q75", 0.75)):
        at = F.lit(p) * (F.col("_n") - 1) + 1
        low = F.max(F.when(F.col("_rank") == F.floor(at), F.col("speed"))).over(segment())
        high = F.max(F.when(F.col("_rank") == F.ceil(at), F.col("speed"))).over(segment())
        columns[name] = low + (high - low) * (at - F.floor(at))
    return ranked.withColumns(columns).drop("_rank", "_n")


def temporal_aggregates() -> dict[str, Column]:
    enough = F.count("speed") >= 3
    raw = {
        "speed_trend": F.regr_slope(F.col("speed"), F.col("speed_pos")),
        "speed_acceleration_mean": F.avg("accel"),
        "speed_acceleration_std": F.stddev_pop("accel"),
    }
    return {name: _zero(F.when(enough, c)) for name, c in raw.items()}


def scalar_features(frames: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """Any of the aggregate groups above in one aggregation."""
    every = {name: column for group in groups for name, column in group.items()}
    if "speed_iqr" in every:
        frames = with_speed_quartiles(frames)
    return with_steps(frames).groupBy(*KEYS).agg(*[c.alias(n) for n, c in every.items()])


def all_scalar_features(frames: DataFrame) -> DataFrame:
    return scalar_features(
        frames,
        basic_aggregates(),
        turning_aggregates(),
        physics_aggregates(),
        statistical_aggregates(),
        temporal_aggregates(),
    )


def turning_frequency(frames: DataFrame, height: float = 90) -> DataFrame:
    """Share of frames that are peaks of the absolute angle: strictly above both sides, flat tops once.

    Runs of equal angles are reduced to their first frame, which leaves the number of peaks as it is.
    """
    angle = F.col("angle")
    known = frames.where(F.col("turning_angle").isNotNull()).select(
        *KEYS, "frame", F.abs(even_angle()).alias("angle"),
        F.count(F.lit(1)).over(segment()).alias("n"),
    )
    runs = known.withColumn("prior", F.lag("angle").over(forward())).where(
        F.col("prior").isNull() | (angle != F.col("prior"))
    )
    peak = (
        (angle > F.lag("angle").over(forward()))
        & (angle > F.lead("angle").over(forward()))
        & (angle >= height)
    )
    return (
        runs.withColumn("peak", peak)
        .groupBy(*KEYS)
        .agg((F.count_if("peak") / F.first("n")).alias("turning_frequency"))
    )


def meandering_features(frames: DataFrame, window_size: int = 30) -> DataFrame:
    """Net displacement over path length in whole windows of ``window_size`` known positions."""
    known = (
        frames.where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .select(*KEYS, "frame", "x", "y")
        .withColumn("pos", F.row_number().over(forward()) - 1)
    )
    dx, dy = F.col("x") - F.lag("x").over(forward()), F.col("y") - F.lag("y").over(forward())
    stepped = known.withColumns(
        {
            "win": F.floor(F.col("pos") / window_size),
            "dist": F.when(F.col("pos") % window_size > 0, F.sqrt(dx * dx + dy * dy)),
        }
    )
    first = F.min_by(F.struct("x", "y"), "pos")
    last = F.max_by(F.struct("x", "y"), "pos")
    net = F.sqrt(
        (last["x"] - first["x"]) * (last["x"] - first["x"])
        + (last["y"] - first["y"]) * (last["y"] - first["y"])
    )
    windows = (
        stepped.groupBy(*KEYS, "win")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("path"), net.alias("net"))
        .where((F.col("n") == window_size) & (F.col("path") > 0))
        .withColumn("ratio", F.col("net") / F.col("path"))
    )
    return windows.groupBy(*KEYS).agg(
        F.avg("ratio").alias("mean_meandering_ratio"),
        F.stddev_pop("ratio").alias("std_meandering_ratio"),
        F.min("ratio").alias("min_meandering_ratio"),
        F.max("ratio").alias("max_meandering_ratio"),
        F.median("ratio").alias("median_meandering_ratio"),
        F.avg(F.when(F.col("ratio") > 0.5, 1.0).otherwise(0.0)).alias(
            "fraction_efficient_movement"
        ),
    )


def with_histogram_bin(
    df: DataFrame, value: str, low: Column, high: Column, bins: int, out: str = "bin"
) -> DataFrame:
    """Add the 0-based equal-width bin of ``value`` over [low, high].

    A value equal to an edge opens the next bin, the top one stays in the last. A constant column is
    binned over half a unit to either side. Built in steps: one expression would repeat its parts.
    """
    flat = high == low
    staged = (
        df.withColumns(
            {
                "_start": F.when(flat, low - 0.5).otherwise(low),
                "_width": F.when(flat, F.lit(1.0)).otherwise(high - low) / bins,
            }
        )
        .withColumn(
            "_guess",
            F.least(F.floor((F.col(value) - F.col("_start")) / F.col("_width")), F.lit(bins - 1)),
        )
        .withColumn(
            "_guess",
            F.col("_guess")
            - (F.col(value) < F.col("_start") + F.col("_guess") * F.col("_width")).cast("long"),
        )
    )
    opens_next = (F.col(value) >= F.col("_start") + (F.col("_guess") + 1) * F.col("_width")) & (
        F.col("_guess") < bins - 1
    )
    return staged.withColumn(out, F.col("_guess") + opens_next.cast("long")).drop(
        "_start", "_width", "_guess"
    )


def channel_values(frames: DataFrame) -> DataFrame:
    """Known speeds and turning angles one below the other: ``(entity, seg, name, frame, v)``."""
    pair = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.col(column).alias("v"))
            for name, column in (("speed", "speed"), ("turning", "turning_angle"))
        ]
    )
    return frames.select(*KEYS, "frame", F.inline(pair)).where(F.col("v").isNotNull())


def entropy_features(frames: DataFrame, bins: int = 20) -> DataFrame:
    """Natural-log entropy of the value histogram of speed and turning angle."""
    channel = Window.partitionBy(*KEYS, "name")
    ranged = channel_values(frames).withColumns(
        {"low": F.min("v").over(channel), "high": F.max("v").over(channel)}
    )
    binned = with_histogram_bin(ranged, "v", F.col("low"), F.col("high"), bins)
    counts = binned.groupBy(*KEYS, "name", "bin").agg(F.count(F.lit(1)).alias("c"))

    # -sum(p ln p) with p = c / n  equals  ln n - sum(c ln c) / n
    def entropy(name: str) -> Column:
        c = F.when(F.col("name") == name, F.col("c"))
        return _zero(F.ln(F.sum(c)) - F.try_divide(F.sum(c * F.ln(c)), F.sum(c)))

    return counts.groupBy(*KEYS).agg(
        *[entropy(name).alias(f"{name}_entropy") for name in ("speed", "turning")]
    )


def curve_length_slopes(stepped: DataFrame, keys: list[str], k_max: int) -> DataFrame:
    """Slope of log curve length on log lag per key, from ``pos``, ``n`` and lagged moves ``d1 …``."""

    def length(k: int) -> Column:
        start = F.col("pos") % k
        points = F.floor((F.col("n") - start) / k)
        used = F.floor(F.col("pos") / k) < points
        scale = (F.col("n") - 1) / (points * k)
        return F.sum(F.when(used & (F.col("pos") >= k), F.col(f"d{k}") * scale))

    lengths = stepped.groupBy(*keys).agg(
        F.array(*[length(k) / k for k in range(1, k_max + 1)]).alias("l")
    )
    lags = [math.log(k) for k in range(1, k_max + 1)]
    centred = [x - sum(lags) / k_max for x in lags]
    slope = sum(
        (F.ln(F.get("l", i)) * (c / sum(x * x for x in centred)) for i, c in enumerate(centred)),
        F.lit(0.0),
    )
    usable = F.forall("l", lambda v: F.coalesce(v > 0, F.lit(False)))
    return lengths.select(*keys, F.when(usable, slope).otherwise(0.0).alias("slope"))


def fractal_features(frames: DataFrame, k_max: int = 10) -> DataFrame:
    """Higuchi dimension: slope of log curve length on log lag.

    At lag k the signal splits into k interleaved series. The step ending at position p belongs to
    the series starting at ``p mod k`` and counts with that series' scale, so a curve length is a
    weighted sum of lagged differences. Signals under ``2 k_max`` points give 0.
    """
    series = Window.partitionBy(*KEYS, "name").orderBy("frame")
    whole = Window.partitionBy(*KEYS, "name")
    placed = channel_values(frames).withColumns(
        {"pos": F.row_number().over(series) - 1, "n": F.count(F.lit(1)).over(whole)}
        | {f"d{k}": move(F.col("v"), F.lag("v", k).over(series)) for k in range(1, k_max + 1)}
    ).where(F.col("n") >= 2 * k_max)

    fitted = curve_length_slopes(placed, [*KEYS, "name"], k_max)
    return fitted.groupBy(*KEYS).agg(
        *[
            _zero(F.max(F.when(F.col("name") == name, F.col("slope")))).alias(f"{name}_fractal_dim")
            for name in ("speed", "turning")
        ]
    )


def frenetic_windows(
    stepped: DataFrame, keys: list[str], window_size: int, step: int
) -> DataFrame:
    """``(keys, win, jerk, score)`` per whole window, from ``pos`` and differences to earlier rows."""
    first = F.greatest(F.ceil((F.col("pos") - window_size + 1) / step), F.lit(0))
    sliding = stepped.withColumn(
        "win", F.explode(F.sequence(first, F.floor(F.col("pos") / step)))
    ).withColumn("inside", F.col("pos") - F.col("win") * step)
    once, twice = F.col("inside") >= 1, F.col("inside") >= 2
    return (
        sliding.groupBy(*keys, "win")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.when(twice, F.abs(F.col("accel") - F.col("accel_before")))).alias("jerk"),
            F.stddev_pop(F.when(once, F.col("accel"))).alias("accel_std"),
            F.stddev_pop(F.when(once, F.col("turn"))).alias("turn_std"),
        )
        .where(F.col("n") == window_size)
        .withColumn(
            "score",
            F.when(
                (F.col("accel_std") > 0) & (F.col("turn_std") > 0),
                F.col("accel_std") * F.col("turn_std"),
            ),
        )
    )


def frenetic_features(
    frames: DataFrame, window_size: int = 10, overlap: int = 5
) -> DataFrame:
    """Erratic movement in sliding windows: spread of acceleration times spread of turning change."""
    step = window_size - overlap
    known = (
        frames.where(F.col("speed").isNotNull() & F.col("turning_angle").isNotNull())
        .select(*KEYS, "frame", "speed", "turning_angle")
        .withColumns(
            {
                "pos": F.row_number().over(forward()) - 1,
                "accel": F.col("speed") - F.lag("speed").over(forward()),
                "turn": F.abs(F.col("turning_angle") - F.lag("turning_angle").over(forward())),
                "accel_before": F.lag("speed").over(forward()) - F.lag("speed", 2).over(forward()),
            }
        )
    )
    windows = frenetic_windows(known, KEYS, window_size, step)
    # at most one score per `step` frames of a segment, so the list is short
    scores, limit = F.collect_list("score"), F.percentile("score", 0.75)
    summed = windows.groupBy(*KEYS).agg(
        F.avg("score").alias("mean_frenetic_score"),
        F.max("score").alias("max_frenetic_score"),
        F.stddev_pop("score").alias("std_frenetic_score"),
        F.struct(scores.alias("all"), limit.alias("limit")).alias("s"),
        F.avg("jerk").alias("mean_jerk"),
        F.max("jerk").alias("max_jerk"),
    )
    above = F.size(F.filter("s.all", lambda v: v > F.col("s.limit")))
    return summed.withColumn(
        "pct_high_frenetic", F.when(F.size("s.all") >= 4, above / F.size("s.all"))
    ).select(*KEYS, *[_zero(F.col(c)).alias(c) for c in FRENETIC])


def behavior_features(frames: DataFrame) -> DataFrame:
    """Activity score of each frame, its mean, and the shares above, below and between quartiles."""
    rows = frames.select(
        *KEYS,
        "speed",
        F.abs("turning_angle").alias("turn"),
        F.max("speed").over(segment()).alias("top_speed"),
        F.max(F.abs("turning_angle")).over(segment()).alias("top_turn"),
    )
    score = 0.7 * F.col("speed") / (F.col("top_speed") + SMALL) + 0.3 * F.col("turn") / (
        F.col("top_turn") + SMALL
    )
    summed = (
        rows.withColumn("score", score)
        .where(F.col("score").isNotNull())
        .groupBy(*KEYS)
        .agg(
            F.avg("score").alias("activity_level"),
            F.collect_list("score").alias("all"),
            F.percentile("score", [0.25, 0.75]).alias("cut"),
        )
    )
    low, high, n = F.get("cut", 0), F.get("cut", 1), F.size("all")
    return summed.select(
        *KEYS,
        "activity_level",
        (F.size(F.filter("all", lambda v: v > high)) / n).alias("high_activity_fraction"),
        (F.size(F.filter("all", lambda v: v < low)) / n).alias("low_activity_fraction"),
        (F.size(F.filter("all", lambda v: (v >= low) & (v <= high))) / n).alias(
            "mixed_activity_fraction"
        ),
    )


def with_zero_default(segments: DataFrame, part: DataFrame, names: list[str]) -> DataFrame:
    """Left-join a feature family to the segment list; segments it has nothing for get 0."""
    joined = segments.join(part, KEYS, "left")
    return joined.withColumns({n: _zero(F.col(n)) for n in names})
