from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pathpulse.session import get_session

    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def frames_of(spark):
    """Frames from columns of equal length; one segment unless ``seg`` is given."""

    def make(**columns):
        n = len(next(iter(columns.values())))
        base = {
            "entity": [1] * n, "seg": [0] * n, "label": [0] * n, "frame": list(range(1, n + 1)),
            "speed": [1.0] * n, "x": [0.0] * n, "y": [0.0] * n, "turning_angle": [0.0] * n,
        } | columns
        schema = (
            "entity long, seg long, label int, frame long, speed double, x double, y double, "
            "turning_angle double"
        )
        for c in ("speed", "x", "y", "turning_angle"):
            base[c] = [None if v is None else float(v) for v in base[c]]
        rows = list(zip(*[base[c.split()[0]] for c in schema.split(", ")]))
        return spark.createDataFrame(rows, schema)

    return make
