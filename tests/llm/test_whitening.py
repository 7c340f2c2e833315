from __future__ import annotations

import math

import numpy as np
import pytest

from pathpulse.llm.whitening import Whitening, components, polar, whitened, whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, p=Whitening()):
    """vec_id -> (deviation, whitened up to sign), and the explained shares."""
    x = np.array([[math.floor(p.scale * float(c)) + p.offset for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    centred = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(p.components, len(values))
    return deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def vectors(n, dim, seed, hot=0):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)) * np.linspace(1.0, 0.2, dim)
    m[:hot] = m[0]
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(m)]


@pytest.mark.parametrize("spectrum", [[5.0, 4, 3, 2, 1], [1.0] * 6, [2.0, 2, 2, 1, 1, 0, 0], [1e8, 1.0, 1e-6], [0.0, 0.0], [3.0]])
def test_components_are_eigenvectors(spectrum):
    rng = np.random.default_rng(len(spectrum))
    basis, _ = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))
    a = basis * spectrum @ basis.T
    a = (a + a.T) / 2
    values, columns = components(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - sorted(spectrum, reverse=True)).max() <= 1e-13 * size
    assert np.abs(columns.T @ columns - np.eye(len(spectrum))).max() < 1e-13
    assert np.linalg.norm(a @ columns - columns * values) <= 1e-13 * size


def test_large_random_covariance():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 120))
    a = x.T @ x / 500
    values, columns = components(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12)
    assert np.linalg.norm(a @ columns - columns * values) < 1e-12 * np.linalg.norm(a)


def test_polar_factor():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = polar(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13
    assert np.linalg.eigvalsh(u @ a).min() > 0


@pytest.mark.parametrize("n, dim, hot", [(400, 12, 0), (300, 5, 120), (60, 3, 0)])
def test_agrees_with_brute_force(spark, n, dim, hot):
    rows = vectors(n, dim, n, hot)
    deviation, z, shares = brute(rows)
    got = whitened_components(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()
    assert len(got) == n * min(dim, 8)
    made = np.full((n, len(shares)), np.nan)
    for r in got:
        made[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-10) and r.identity_error < 1e-10
    signs = np.sign((made * z).sum(0))
    assert np.abs(made * signs - z).max() < 1e-9


def test_rows_that_do_not_count(spark):
    good = vectors(50, 4, 1)
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf")] * 4),
           (904, []), (905, [1.0, 2.0]), (906, [1e30] * 4), (907, [-1e30, 0.0, 0.0, 0.0])]
    again = [(None, good[3][1]), (7, good[7][1])]
    rows = good + again
    got = whitened(spark.createDataFrame([(*r, None) for r in good + bad + again], SCHEMA)).collect()
    assert sorted(r.vec_id for r in got if r.vec_id is not None) == sorted(k for k, _ in rows if k is not None)
    assert len(got) == 52 and {r.n for r in got} == {52}
    deviation, _, _ = brute(rows)
    assert sorted(int(r.deviation) for r in got) == sorted(deviation)


def test_no_variance_huge_entries_and_empty_table(spark):
    same = spark.createDataFrame([(k, [0.5, -0.5], 0) for k in range(9)], SCHEMA)
    got = whitened_components(same).collect()
    assert len(got) == 18 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(0, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], 0) for k in range(9)], SCHEMA)
    got = {r.vec_id: r for r in whitened(line).collect()}
    assert got[0].explained[0] == pytest.approx(1.0) and got[0].whitened[1] == 0.0 and got[0].identity_error < 1e-9
    far = spark.createDataFrame([(k, [1e9 * k, float(k)], 0) for k in range(3)], SCHEMA)
    deviation, _, _ = brute([(k, [float(np.float32(1e9 * k)), float(k)]) for k in range(3)])
    assert {r.vec_id: int(r.deviation) for r in whitened(far).collect()} == dict(enumerate(deviation))
    assert whitened_components(same.limit(0)).collect() == []


def test_columns_that_clash(spark):
    rows = [(*r, 1, 2.0) for r in vectors(30, 3, 5)]
    clash = spark.createDataFrame(rows, SCHEMA.replace("label", "n") + ", x double")
    assert whitened(clash).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitened(clash).first().n == 30
