from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pathpulse.functions import filenames
from pathpulse.operators import segments
from pathpulse.operators.gaps import repair_gaps
from pathpulse.operators.geometry import turning_angles
from pathpulse.params import TrackParams


def column(df, name):
    return [row[name] for row in df.orderBy("frame").collect()]


def test_short_gap_is_filled_and_edges_follow_the_rule(frames_of):
    x = [None, 1.0, None, 3.0, None, None]
    out = repair_gaps(frames_of(x=x, y=x), TrackParams())
    assert column(out, "x") == [None, 1.0, 2.0, 3.0, 3.0, 3.0]


@pytest.mark.parametrize("length, kept", [(6, 8), (7, 1 + 1)])
def test_long_gap_vanishes(frames_of, length, kept):
    x = [0.0, *[None] * length, 7.0]
    assert repair_gaps(frames_of(x=x, y=x), TrackParams()).count() == kept


def test_gap_between_limits_stays_missing(frames_of):
    x = [0.0, None, None, 3.0]
    out = repair_gaps(frames_of(x=x, y=x), TrackParams(interp_limit=1, long_gap=3))
    assert column(out, "x") == x


def test_interpolation_is_exact_on_straight_lines(frames_of):
    random.seed(1)
    x = [0.5 * i for i in range(60)]
    holes = [None if random.random() < 0.3 and 0 < i < 59 else v for i, v in enumerate(x)]
    out = repair_gaps(frames_of(x=holes, y=holes), TrackParams(interp_limit=20, long_gap=30))
    assert column(out, "x") == pytest.approx(x)


def test_gaps_do_not_cross_segments(frames_of):
    x = [0.0, None, None, 3.0]
    out = repair_gaps(
        frames_of(x=x, y=x, seg=[0, 0, 1, 1]), TrackParams(interp_limit=1, long_gap=2)
    )
    assert column(out, "x") == [0.0, 0.0, None, 3.0]


def test_square_path_turns_by_ninety(frames_of):
    out = turning_angles(frames_of(x=[0.0, 1, 1, 0, 0], y=[0.0, 0, 1, 1, 0]))
    assert column(out, "turning_angle") == pytest.approx([0, 90, 90, 90, 0])


def test_turning_wraps(frames_of):
    a, b = math.radians(170), math.radians(-170)
    x = [0.0, math.cos(a), math.cos(a) + math.cos(b)]
    y = [0.0, math.sin(a), math.sin(a) + math.sin(b)]
    assert column(turning_angles(frames_of(x=x, y=y)), "turning_angle")[1] == pytest.approx(20)


def test_turning_ignores_rotation_and_shift(frames_of):
    random.seed(2)
    x, y = [random.random() for _ in range(30)], [random.random() for _ in range(30)]
    c, s = math.cos(0.7), math.sin(0.7)
    turned = frames_of(
        x=[c * a - s * b + 5 for a, b in zip(x, y)], y=[s * a + c * b - 3 for a, b in zip(x, y)]
    )
    assert column(turning_angles(turned), "turning_angle") == pytest.approx(
        column(turning_angles(frames_of(x=x, y=y)), "turning_angle"), abs=1e-8
    )


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_segments_do_not_turn(frames_of, n):
    assert column(turning_angles(frames_of(x=[1.0] * n, y=[2.0] * n)), "turning_angle") == [0] * n


def test_speed_cap_keeps_missing(frames_of):
    out = frames_of(speed=[None, 3.0, 12.0]).withColumn("speed", segments.cap_speed(F.col("speed"), 10))
    assert column(out, "speed") == [None, 3.0, 10.0]


def test_names(spark):
    rows = spark.createDataFrame(
        [
            ("/d/coordinates_highestspeed_20240827_1_1.csv", "/20240827_piworm01_1"),
            ("/d/coordinates_highestspeed_20240827_123_4-x.csv", "/20240827_piworm123_4"),
            ("/d/other_20240827_1_1.csv", None),
        ],
        "p string, want string",
    )
    for row in rows.withColumn("got", filenames.lookup_key(F.col("p"))).collect():
        assert row["got"] == row["want"]
    name = spark.createDataFrame(
        [("a-segment5.0-preprocessed.csv", "a", 5), ("b-preprocessed.csv", "b", 0)],
        "f string, e string, s int",
    )
    got = name.select(filenames.entity_of(F.col("f")), filenames.segment_of(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("a", 5), ("b", 0)]


def test_bounds_default_without_values(frames_of):
    row = segments.coordinate_bounds(
        frames_of(x=[None], y=[None], turning_angle=[None], speed=[None])
    ).first()
    assert (row["turning_angle_min"], row["turning_angle_max"]) == (-180, 180)
    assert (row["x_min"], row["x_max"], row["files_with_xy"]) == (0, 1, 0)
