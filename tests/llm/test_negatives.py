from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathpulse.llm.negatives import Mining, augmented, bounds, cover_tree, farthest_first, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, p):
    """Every anchor against every row, with whole numbers."""
    x = {}
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            x[k, label, tuple(math.floor(p.scale * float(np.float32(c))) for c in v)] = None
    out = []
    for k, label, v in x:
        if not anchor(k):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in x]
        for minus, j, other in sorted(s for s in scored if s[2] == label and s[1] != k)[: p.positives]:
            fits = sorted((m, i) for m, i, o in scored if o != label and p.low_percent * -minus <= 100 * -m <= p.high_percent * -minus)
            out += [(k, j, rank + 1, i, -minus, -m) for rank, (m, i) in enumerate(fits[: p.negatives])]
    return sorted(out)


def got(spark, rows, every, p, schema=SCHEMA):
    rows = [(k, v and [c if c is None else float(c) for c in v], *rest) for k, v, *rest in rows]
    docs = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in hard_negatives(docs, F.col("vec_id") % every == 0, p).collect())


def clusters(n, dim, seed, labels=3, hot=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    m = centres[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dim))
    m[rng.random(n) < hot] = centres[0]
    return [(k, [float(c) for c in v], int(rng.integers(0, labels))) for k, v in enumerate(m)]


@pytest.mark.parametrize("p, hot", [(Mining(), 0.0), (Mining(block_rows=40, unit_anchors=7, leaf_rows=3), 0.0),
                                    (Mining(block_rows=50, leaf_rows=4, positives=3, negatives=8, low_percent=50, high_percent=90), 0.4)])
def test_agrees_with_brute_force(spark, p, hot):
    rows = clusters(420, 6, p.block_rows, hot=hot)
    want = brute(rows, lambda k: k % 10 == 0, p)
    assert got(spark, rows, 10, p) == want and len(want) > 100


def test_rows_without_part_repeats_and_ties(spark):
    p = Mining(block_rows=20, leaf_rows=2)
    rows = clusters(90, 3, 4)
    rows += [(None, [1.0, 1, 1], 0), (500, None, 1), (510, [1.0, None, 2], 1), (520, [float("nan"), 0, 0], 1), (530, [float("inf"), 0, 0], 1),
             (540, [1.0, 1, 1], None), (550, [], 1), (560, [1.0], 1), (570, [1e30, 0, 0], 1)]
    rows += rows[:30] + [(600 + k, [0.5, 0.5, 0.5], k % 3) for k in range(40)] + [(700, [0.0, 0.0, 0.0], 0), (700, [0.5, 0.5, 0.5], 2)]
    counted = [r for r in rows if r[0] not in (550, 560, 570)]
    assert got(spark, rows, 10, p) == brute(counted, lambda k: k % 10 == 0, p)


def test_few_rows_clashing_columns_and_empty_table(spark):
    p = Mining()
    assert got(spark, [], 1, p) == [] and got(spark, [(0, [1.0, 2.0], 1)], 1, p) == []
    rows = [(0, [1.0, 0.0], 1, 5, 2), (1, [1.0, 0.1], 1, 6, 3), (2, [0.9, 0.0], 0, 7, 4)]
    schema = SCHEMA + ", x int, anchor int"
    assert got(spark, rows, 1, p, schema) == brute([r[:3] for r in rows], lambda k: True, p) != []
    assert got(spark, [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.9, 0.0], 2)], 1, p) == []


@pytest.mark.parametrize("kind", ["normal", "clusters", "same", "line"])
def test_tree_covers_and_bounds_hold(kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.standard_normal((400, 8)), "clusters": np.repeat(rng.standard_normal((8, 5)), 50, 0) + 0.01 * rng.standard_normal((400, 5)),
         "same": np.ones((400, 4)), "line": np.arange(400.0)[:, None] * np.ones((1, 2))}[kind]
    x = np.floor(100 * x)
    norm = float(np.sqrt((x * x).sum(1)).max())
    points = augmented(x, norm)
    assert np.allclose((points * points).sum(1), norm**2)
    p = Mining(leaf_rows=5)
    t = cover_tree(points, norm, p)
    assert sorted(t.rows) == list(range(400))
    q = np.floor(100 * rng.standard_normal((6, x.shape[1])))
    size = np.sqrt((q * q).sum(1))

    def below(node):
        kids = t.children[t.child_at[node] : t.child_at[node + 1]]
        rows = [t.rows[t.row_at[node] : t.row_at[node + 1]], *(below(k) for k in kids)]
        rows = np.concatenate(rows)
        assert np.sqrt(((points[rows] - points[t.centre[node]]) ** 2).sum(1)).max() <= t.radius[node] + 1e-6
        for k in kids:
            assert np.sqrt(((points[t.centre[k]] - points[t.centre[kids[0]]]) ** 2).sum()) > t.radius[node] / p.base or k == kids[0]
        low, high = bounds(q @ x[t.centre[[node]]].T, size, t.radius[[node]], norm)
        scores = q @ x[rows].T
        assert (scores >= low).all() and (scores <= high).all()
        return rows

    below(0)


def test_farthest_first_covers():
    points = np.random.default_rng(1).standard_normal((200, 3))
    centres, which, far = farthest_first(points, 0, 0.8, 200)
    assert far.max() <= 0.8 and np.allclose(far, np.sqrt(((points - points[centres][which]) ** 2).sum(1)), atol=1e-6)
