"""The split paths that only large groups take, forced on small data, against the plain ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pathpulse.operators import classifiers, neighbors, ordered
from pathpulse.operators.neighbors import FOUND, _best, nearest_neighbors
from pathpulse.operators.numbering import largest_group, number_rows, order_block, seg_block
from pathpulse.sources.event_tracks import event_tracks


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, one value half of that key's."""
    rng = np.random.default_rng(0)
    rows = [(0, 5.0 if i % 2 else float(v)) for i, v in enumerate(rng.normal(size=700))]
    rows += [(int(k), float(v)) for k, v in zip(rng.integers(1, 9, 1400), rng.integers(0, 40, 1400))]
    return spark.createDataFrame(
        [(i, k, v) for i, (k, v) in enumerate(rows)], "id long, k int, value double"
    ).repartition(5)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_blocks_are_bounded_and_positions_equal(skewed):
    block = order_block(skewed, ["k"], F.col("id"), max_rows=60)
    assert block is not None
    assert largest_group(skewed.withColumn("b", block), ["k", "b"]) <= 60
    split = number_rows(
        skewed, ["k"], ["id"], block, total="n", extra={"top": (F.col("id"), "max")}
    )
    plain = number_rows(
        skewed, ["k"], ["id"], None, total="n", extra={"top": (F.col("id"), "max")}
    )
    cols = ["id", "k", "pos", "n", "top"]
    assert rows_of(split.select(cols), "id") == rows_of(plain.select(cols), "id")


def test_small_groups_need_no_blocks(skewed):
    assert order_block(skewed, ["k"], F.col("id"), max_rows=10_000) is None


def test_tracks_are_the_same_when_users_are_split(spark, small):
    whole, split = event_tracks(spark, small), event_tracks(spark, small, max_rows=7)
    assert rows_of(whole, "entity", "frame") == rows_of(split, "entity", "frame")


def test_segment_blocks(spark):
    segs = spark.range(1000).select(F.lit("a").alias("entity"), F.col("id").alias("seg"))
    out = number_rows(segs, ["entity"], ["seg"], seg_block(size=16), "pos", total="n")
    assert out.where("pos <> seg + 1 or n <> 1000").count() == 0


def test_running_counts_in_blocks(skewed):
    measures = {"n": F.count(F.lit(1)), "s": F.sum("id")}
    split = ordered.ordered_counts(skewed, ["k"], "value", measures, max_rows=50)
    plain = ordered.ordered_counts(skewed, ["k"], "value", measures)
    cols = ["k", "value", "n", "n_before", "n_total", "s", "s_before", "s_total"]
    assert rows_of(split.select(cols), "k", "value") == rows_of(plain.select(cols), "k", "value")


def test_running_counts_without_key(skewed):
    split = ordered.ordered_counts(skewed, [], "value", {"n": F.count(F.lit(1))}, max_rows=50)
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.groupBy("value").count().select(
        "value", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("b")
    )
    assert rows_of(split.select("value", "n_before"), "value") == rows_of(want, "value")


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_quantiles_of_large_groups(skewed, monkeypatch, keys, accuracy):
    # a coarse sketch widens the brackets, so values outside them are lumped
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", accuracy)
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = ordered.exact_quantiles(skewed, keys, "value", probs, max_rows=10)
    pdf = skewed.toPandas()
    parts = pdf.groupby("k")["value"] if keys else [(None, pdf["value"])]
    want = {k: np.quantile(v, probs).tolist() for k, v in parts}
    for row in got.collect():
        assert row["q"] == pytest.approx(want[row["k"] if keys else None])


def test_quantiles_recover_from_a_missed_bracket(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", 4 * 10**9)
    real = ordered._lumped_counts

    def narrow(*args):
        monkeypatch.setattr(ordered, "SKETCH_ACCURACY", 10_000)
        return real(*args)

    monkeypatch.setattr(ordered, "_lumped_counts", narrow)
    got = ordered.exact_quantiles(skewed, ["k"], "value", [0.33], max_rows=10)
    pdf = skewed.toPandas()
    for row in got.collect():
        want = np.quantile(pdf[pdf["k"] == row["k"]]["value"], 0.33)
        assert row["q"][0] == pytest.approx(want)


@pytest.mark.parametrize("block_rows", [2000, 16])
def test_neighbours_are_exact_with_copies(spark, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(scale=6, size=(5, 4))
    pts = (centres[rng.integers(0, 5, 200)] + rng.normal(size=(200, 4))).round(3)
    pts[100:150] = pts[0]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, vec array<double>")
    got = nearest_neighbors(df, 5, block_rows).collect()
    distinct = {tuple(p) for p in pts.tolist()}
    assert len(got) == len(distinct)
    for row in got:
        others = np.array([p for p in distinct if p != tuple(row["vec"])])
        want = np.sort(np.sqrt(((others - np.array(row["vec"])) ** 2).sum(1)))[:5]
        assert [n["dist"] for n in row["nn"]] == pytest.approx(want.tolist())
        if tuple(row["vec"]) == tuple(pts[0].tolist()):
            assert row["copies"] == 51


def test_blocks_are_cut_again_until_they_fit(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CUTS", 7)
    rows = [("big", (k * 7919) % 5000 / 3) for k in range(6000)] + [("small", float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "k string, value double")
    seen = []
    real = ordered.largest_group
    monkeypatch.setattr(ordered, "largest_group", lambda d, keys: seen.append((len(keys), real(d, keys))) or seen[-1][1])
    measures = {"n": F.count(F.lit(1))}
    cols = ["k", "value", "n", "n_before", "n_total"]
    split = ordered.ordered_counts(df, ["k"], "value", measures, max_rows=40).select(cols)
    plain = ordered.ordered_counts(df, ["k"], "value", measures, None).select(cols)
    assert rows_of(split, "k", "value") == rows_of(plain, "k", "value")
    # the key alone, then with one, two, … levels of blocks
    assert max(n for n, _ in seen) >= 4 and seen[-1][1] <= 40


def test_blocks_that_cannot_be_cut_end(spark):
    df = spark.createDataFrame([(2**60 + k,) for k in range(90)], "value long")
    split = ordered.ordered_counts(df, [], "value", {"n": F.count(F.lit(1))}, max_rows=20).collect()
    assert sorted((r["value"] - 2**60, r["n_before"]) for r in split) == [(k, k) for k in range(90)]


def test_neighbours_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(6)
    vectors = np.vstack([rng.standard_normal((300, 64)), np.repeat(rng.standard_normal((2, 64)), 40, 0)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, vec array<double>")
    first = {tuple(v): k for k, v in reversed(list(enumerate(map(tuple, vectors))))}
    distinct = sorted(first.values())
    for block_rows in (9, 5000):
        got = {r["id"]: [x["id"] for x in r["nn"]] for r in nearest_neighbors(df, 4, block_rows).collect()}
        assert sorted(got) == distinct
        for k in distinct:
            dist = {j: float(np.sqrt(((vectors[j] - vectors[k]) ** 2).sum())) for j in distinct if j != k}
            assert got[k] == sorted(dist, key=lambda j: (dist[j], j))[:4]


def test_neighbours_are_limited_before_they_are_shuffled(spark):
    found = spark.createDataFrame([(1, 0.5, 2, 1)], FOUND)
    plan = _best(found, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_rows_stay_where_they_are_when_keys_are_few(skewed):
    """Joined by a shuffle, the rows of four features lay in four tasks: memory of a task grew with the table."""
    counts = ordered._lumped_counts(skewed, ["k"], "value", [0.25, 0.5])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_points_are_sent_to_few_large_blocks(spark, monkeypatch):
    """In many dimensions nearly every cell is in reach; cells of fewer rows than a block sent each point to more of them."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 16))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>")
    cells = []
    search = neighbors._search

    def seen(visitors, residents, chunks, k):
        cells.append(residents.select("cell").distinct().count())
        return search(visitors, residents, chunks, k)

    monkeypatch.setattr(neighbors, "_search", seen)
    near = {row["id"]: [x["id"] for x in row["nn"]] for row in nearest_neighbors(points, 3, block_rows=100).collect()}
    assert max(cells) <= 3
    distances = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))
    np.fill_diagonal(distances, np.inf)
    assert near == {i: np.argsort(row, kind="stable")[:3].tolist() for i, row in enumerate(distances)}


def test_wide_vectors_are_not_read_in_large_batches_and_flat_places_are_left_out(spark):
    """a net over 1,200 places kept whole batches, blocks and all folds in memory, though most places never vary."""
    rng = np.random.default_rng(4)
    flat = [0.0] * (classifiers.WIDE - 2)
    rows = [(i, i // 4, i % 5, i % 2, [*(rng.normal(i % 2 * 3, 1, 3).tolist()), *flat]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, entity long, fold int, label int, vec array<double>")
    table = classifiers.matrix(df)
    assert "parquet" not in table._jdf.queryExecution().toString().lower()
    assert classifiers._varying(table) == (0, 1, 2)
    assert table.rdd.getNumPartitions() == 1 and classifiers.matrix(df, 50).rdd.getNumPartitions() == 4
    held = classifiers.cross_validated(df, "MLP", range(2), maxIter=20, layers=[3, 4, 2]).collect()
    assert len(held) == 80 and sum(r["prediction"] == r["label"] for r in held) > 70
    big = [{0: 60_000, 1: 60_000}] * 5
    assert classifiers._together(big, 1200, 8) == 1 and classifiers._together(big, 40, 8) == 5
    assert classifiers.classifier("MLP", 1200).getStages()[-1].getBlockSize() == 27


def test_searches_in_groups_come_in_waves_and_find_the_same(spark):
    """all blocks of all groups were sent at once, so the disk they took grew with the square of a group."""
    rng = np.random.default_rng(6)
    rows = [(g, i, v.tolist()) for g, n in ((0, 210), (3, 35), (5, 1)) for i, v in enumerate(rng.integers(0, 9, (n, 4)).astype(float))]
    points = spark.createDataFrame(rows, "group int, id long, vec array<double>")
    sizes = {0: 210, 3: 35, 5: 1}
    waves = neighbors._waves(sizes, 20, 1_000)
    blocks = {(g, b) for w in waves for g, (a, e) in w.items() for b in range(a, e)}
    assert len(waves) > 3 and blocks == {(g, b) for g, n in sizes.items() for b in range(-(-n // 20))}
    assert all(sum(2 * sizes[g] * (e - a) for g, (a, e) in w.items()) <= 1_000 for w in waves)
    got = {(r.group, r.id): r.nn for r in neighbors.nearest_in_groups(points, 5, 20, 1_000).collect()}
    assert got == {(r.group, r.id): r.nn for r in neighbors.nearest_in_groups(points, 5).collect()}
    assert got[5, 0] == [] and all(len(nn) == 5 for (g, _), nn in got.items() if g == 0)
    assert neighbors.nearest_in_groups(points.limit(0), 5).collect() == []


def test_visits_come_in_waves_and_find_the_same(spark, monkeypatch):
    """every point was sent to every cell in reach at once, so disk grew with the square of the points."""
    rng = np.random.default_rng(8)
    vectors = np.vstack([rng.standard_normal((260, 16)), rng.integers(0, 2, (60, 16))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>")
    whole = {r["id"]: (r["copies"], r["nn"]) for r in nearest_neighbors(points, 5, 400).collect()}
    monkeypatch.setattr(neighbors, "PAIRS_AT_ONCE", 50)
    sent = []

    def kept(df):
        sent.append(df)
        return df.localCheckpoint()

    monkeypatch.setattr("pathpulse.session.stored", kept)
    got = {r["id"]: (r["copies"], r["nn"]) for r in nearest_neighbors(points, 5, 7, copies_at_once=900).collect()}
    assert len(sent) > 3 and sum(df.count() for df in sent) == len(whole)
    assert got == whole
