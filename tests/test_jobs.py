"""Whole jobs and their stored tables; whole tracks of every length."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from pathpulse.operators import compare, long_spectrum, long_tracks
from pathpulse.plans import importances, temporal
from pathpulse.plans.comparison import first_last_job
from pathpulse.plans.extract import FEATURES, extract_features
from pathpulse.plans.full_extract import extract_full_features


@pytest.fixture(scope="module")
def ageing(spark):
    """Speed falls with age in 16 entities of 12 segments; the second feature is noise."""
    rng = np.random.default_rng(21)
    rows = [(e, s, e % 2, 5.0 - 0.3 * s + 0.5 * (e % 2) + float(rng.normal()) / 3, float(rng.normal())) for e in range(16) for s in range(12)]
    return spark.createDataFrame(rows, "entity long, seg long, label int, mean_speed double, noise double").cache()


@pytest.mark.parametrize("definition, threshold", [("percentage", 50), ("absolute", 3)])
def test_first_and_last_are_stored_in_rank_order(spark, ageing, tmp_path, definition, threshold):
    path = str(tmp_path)
    results = first_last_job(ageing, path, definition=definition, threshold=threshold).collect()
    assert {r["feature"] for r in results} == {"mean_speed", "noise"}
    best = next(r for r in results if r["rank_combined"] == 1)
    assert best["feature"] == "mean_speed" and best["t_significant"] and best["first_mean"] > best["last_mean"]
    if definition == "absolute":
        assert (best["n_first"], best["n_last"]) == (48, 48)
    text = next((tmp_path / "results_csv").glob("*.csv")).read_text().splitlines()
    assert text[1].startswith("mean_speed,") and len(text) == 3
    assert spark.read.parquet(f"{path}/summary").first()["features"] == 2
    with pytest.raises(ValueError):
        compare.first_against_last(ageing, ["noise"], "relative")


def test_temporal_analyses_are_stored_with_a_summary(ageing, tmp_path):
    summary = {r["analysis"]: r["significant"] for r in temporal.temporal_job(ageing, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name, significant in summary.items():
        found = con.execute(f"SELECT count(*) FILTER (p_value < 0.05) FROM '{tmp_path}/analyses/analysis={name}/*.parquet'").fetchone()[0]
        assert found == significant, name
    assert summary["decreasing"] >= 1 and summary["early_late"] >= 1
    assert con.execute(f"SELECT count(*) FROM '{tmp_path}/analyses/analysis=condition_means/*.parquet'").fetchone()[0] == 2 * 2 * 5


def test_importance_is_stored(ageing, tmp_path):
    tables = importances.importance_job(ageing, str(tmp_path), ["mean_speed", "noise"], top=1, k=3, numTrees=6, maxDepth=4)
    assert tables["all_features"].count() == 2 and len(tables["top_features"].collect()) == 1
    assert [r["n_features"] for r in tables["performance"].collect()] == [1]
    lines = next((tmp_path / "all_features_csv").glob("*.csv")).read_text().splitlines()
    assert lines[0].startswith("feature,") and len(lines) == 3


def walk(frames_of, n, seed):
    rng = np.random.default_rng(seed)
    speed = np.abs(rng.normal(2, 1, n)).round(3)
    x, y = rng.normal(size=n).cumsum().round(3), rng.normal(size=n).cumsum().round(3)
    turn = rng.uniform(-1, 1, n).round(3)
    hide = lambda v, share: [None if rng.random() < share else float(c) for c in v]
    return frames_of(speed=hide(speed, 0.02), x=hide(x, 0.02), y=hide(y, 0.02), turning_angle=hide(turn, 0.02))


@pytest.mark.parametrize("n, chunk", [(700, 64), (333, 50), (40, 64)])
def test_whole_tracks_in_chunks_equal_one_segment(spark, frames_of, monkeypatch, n, chunk):
    """A track of one segment has the same features however it is cut, with the long transform and without."""
    frames = walk(frames_of, n, n).cache()
    want = extract_features(frames).first()
    monkeypatch.setattr(long_tracks, "CHUNK", chunk)
    for limit in (1, 1 << 20):
        monkeypatch.setattr("pathpulse.plans.full_extract.spectrum_features", lambda f, limit=limit: long_spectrum.spectrum_features(f, limit))
        got = extract_full_features(frames).first()
        for f in FEATURES:
            assert got[f] == pytest.approx(want[f], rel=1e-6, abs=1e-7), (f, limit)
