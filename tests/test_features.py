from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pathpulse.functions import signal
from pathpulse.operators import features_native as native
from pathpulse.operators import long_tracks
from pathpulse.operators.geometry import turning_angles
from pathpulse.plans.extract import FEATURES, extract_features

# Worked out by hand and by numpy from the published formulas.
GOLDEN = {
    "mean_speed": 0.496875, "std_speed": 0.321192594, "total_distance": 31.6006347, "time_paused": 6,
    "speed_skewness": 0.0168665345, "speed_kurtosis": -1.23241811, "speed_iqr": 0.6,
    "speed_cv": 0.646424046, "kinetic_energy_proxy": 0.17421875, "movement_efficiency": 0.496874992,
    "speed_persistence": 1.54696423, "speed_trend": 9.15750916e-06,
    "speed_acceleration_mean": 0.00158730159, "speed_acceleration_std": 0.52959765,
    "speed_entropy": 2.39561136, "turning_entropy": 2.56339164, "speed_fractal_dim": -1.13306881,
    "turning_fractal_dim": -1.25024677, "speed_dominant_freq": 22, "turning_dominant_freq": 24,
    "speed_spectral_centroid": 18.439103, "turning_spectral_centroid": 19.4914708,
    "wavelet_speed_level0": 0.160666704, "wavelet_speed_level1": 0.279009601,
    "wavelet_speed_level2": 0.301146074, "wavelet_speed_level3": 0.375835684,
    "wavelet_turning_level0": 0.245230205, "wavelet_turning_level1": 0.350001825,
    "wavelet_turning_level2": 0.61004046, "wavelet_turning_level3": 0.748623556,
    "mean_roaming_score": 0.248840184, "std_roaming_score": 0.000216904836, "fraction_roaming": 1,
    "mean_frenetic_score": 0.1276965, "max_frenetic_score": 0.135802469,
    "std_frenetic_score": 0.00484062895, "pct_high_frenetic": 0.181818182, "mean_jerk": 0.8,
    "max_jerk": 0.825, "mean_meandering_ratio": 0.0115463863, "median_meandering_ratio": 0.0115463863,
    "activity_level": 0.51031199, "high_activity_fraction": 0.25, "low_activity_fraction": 0.25,
    "mixed_activity_fraction": 0.5,
}


def golden_columns():
    i = range(64)
    return {
        "speed": [((7 * k) % 11) / 10 for k in i],
        "turning_angle": [(((5 * k) % 13) - 6) / 6 for k in i],
        "x": [((3 * k) % 17) / 16 for k in i],
        "y": [((4 * k) % 19) / 18 for k in i],
    }


def test_there_are_57_features():
    assert len(FEATURES) == len(set(FEATURES)) == 57


def test_golden_segment(frames_of):
    row = extract_features(frames_of(**golden_columns())).first()
    for name, want in GOLDEN.items():
        assert row[name] == pytest.approx(want, rel=1e-7, abs=1e-11), name


def test_features_do_not_depend_on_row_order(frames_of, spark):
    frames = frames_of(**golden_columns())
    shuffled = extract_features(frames.orderBy("y", "x").repartition(3)).first()
    for name in FEATURES:
        assert shuffled[name] == pytest.approx(extract_features(frames).first()[name], rel=1e-9), name
        break
    assert shuffled["wavelet_speed_level2"] == pytest.approx(GOLDEN["wavelet_speed_level2"], rel=1e-7)


def test_tiny_segment_falls_back_to_zero(frames_of):
    row = extract_features(frames_of(speed=[0.5], x=[1.0], y=[1.0], turning_angle=[0.0])).first()
    assert row["mean_speed"] == 0.5 and row["std_speed"] == 0
    for name in ("speed_trend", "speed_fractal_dim", "mean_frenetic_score", "speed_dominant_freq"):
        assert row[name] == 0


def test_segment_without_positions(frames_of):
    row = extract_features(
        frames_of(speed=[0.5, 0.6], x=[None, None], y=[None, None], turning_angle=[0.0, 0.0])
    ).first()
    assert row["mean_speed"] == 0 and row["mean_turning_angle"] == 0
    assert row["kinetic_energy_proxy"] > 0


@pytest.mark.parametrize("seed", range(5))
def test_peaks_with_plateaus(frames_of, seed):
    rng = np.random.default_rng(seed)
    angle = rng.integers(0, 4, 80) / 3
    want, i = 0, 1
    while i < len(angle) - 1:
        j = i
        while j < len(angle) - 1 and angle[j + 1] == angle[i]:
            j += 1
        if angle[i - 1] < angle[i] and j < len(angle) - 1 and angle[j + 1] < angle[i] and angle[i] >= 0.5:
            want += 1
        i = j + 1
    got = native.turning_frequency(frames_of(turning_angle=angle.tolist()), 0.5).first()
    assert got["turning_frequency"] == pytest.approx(want / 80)


def test_constant_speed_histogram(frames_of):
    row = native.entropy_features(frames_of(speed=[2.0, 2, 2], turning_angle=[0.0, 0, 0])).first()
    assert row["speed_entropy"] == 0


@pytest.mark.parametrize("n", [20, 33, 64, 101])
def test_fractal_dimension_against_loops(frames_of, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    logs = []
    for k in range(1, 11):
        total = 0.0
        for m in range(k):
            q = (n - m) // k
            if q > 1:
                steps = sum(abs(x[m + i * k] - x[m + (i - 1) * k]) for i in range(1, q))
                total += steps * (n - 1) / (q * k)
        logs.append(np.log(total / k))
    want = np.polyfit(np.log(range(1, 11)), logs, 1)[0]
    got = native.fractal_features(frames_of(speed=x.tolist(), turning_angle=[0.0] * n)).first()
    assert got["speed_fractal_dim"] == pytest.approx(want, rel=1e-9)
    assert got["turning_fractal_dim"] == 0


def test_wavelet_taps():
    low = signal.DB4_LOW
    assert low.sum() == pytest.approx(2**0.5) and (low**2).sum() == pytest.approx(1)
    for power in range(4):
        assert (signal.DB4_HIGH * np.arange(8) ** power).sum() == pytest.approx(0, abs=1e-9)


def test_smoothing_keeps_constants():
    assert signal.smooth(np.full(9, 3.0)) == pytest.approx(np.full(9, 3.0))


def test_short_signals():
    assert signal.wavelet_spread(np.ones(3)) == [0, 0, 0, 0]
    assert signal.spectrum(np.ones(7)) == (0, 0)


@pytest.mark.parametrize("n", [5, 299, 300, 301, 777])
def test_resampling(spark, n):
    from pyspark.sql import functions as F

    from pathpulse.operators.resample import fixed_length

    seq = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(
            F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("speed"),
            i.cast("double").alias("turning_angle"),
        ),
    )
    got = spark.range(1).select(fixed_length(seq, 300).alias("s")).select("s.turning_angle").first()[0]
    if n >= 300:
        assert got == np.linspace(0, n - 1, 300, dtype=int).tolist()
    else:
        assert got == [*range(n), *[0] * (300 - n)]
    assert pd.Series(got).notna().all()


def mirrored(n=24):
    """Two turns of one size in a row, the second a rounding error short of the first, on rising turns."""
    return [i / 100 for i in range(n - 4)] + [0.6, -0.6 * (1 - 2**-52), 0.7, 0.8]


def test_a_turn_and_its_mirror_image_are_one_flat_top(frames_of):
    """At 1 GB rounding made a peak of two equal turns on the way up."""
    got = native.turning_frequency(frames_of(turning_angle=mirrored(), seg=[0] * 24), 0.5)
    assert got.first()["turning_frequency"] == 0
    whole = long_tracks.turning_frequency(frames_of(turning_angle=mirrored()), 0.5)
    assert whole.first()["turning_frequency"] == 0


def test_rounding_errors_are_no_curve_length(frames_of):
    """A signal that is back at its start after ten steps has no length at lag 10, so no dimension."""
    angles = [0.0, *[((7 * k) % 11) / 10 + 0.1 for k in range(9)], 1e-17, *[((5 * k) % 13) / 12 for k in range(9)]]
    frames = frames_of(turning_angle=angles)
    assert native.fractal_features(frames).first()["turning_fractal_dim"] == 0
    assert long_tracks.fractal_features(frames).first()["turning_fractal_dim"] == 0


def test_a_reversal_turns_by_minus_180(frames_of):
    """The range is [-180, 180); the SQL's last digits give 180 here."""
    out = turning_angles(frames_of(x=[56.58, 143.64, 56.58], y=[119.84, 247.17000000000002, 119.84]))
    assert [row["turning_angle"] for row in out.orderBy("frame").collect()] == [0.0, -180.0, 0.0]
