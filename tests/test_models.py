from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathpulse.operators import balance, classifiers, evaluation, importance, impute, projection
from pathpulse.catalog import models
from pathpulse.operators import thresholds as choice
from pathpulse.operators.neighbors import nearest_in_groups
from pathpulse.operators import voting
from pathpulse.plans import predictor


@pytest.fixture(scope="module")
def separable(spark):
    """Class 1 is shifted in the first of three features; 20 entities of 12 rows."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        entity = i // 12
        label = int(entity % 4 == 0)
        vec = rng.normal(size=3)
        vec[0] += 3 * label
        rows.append((i, entity, i % 12, label, vec.tolist(), entity % 3))
    return spark.createDataFrame(
        rows, "id long, entity long, seg long, label int, vec array<double>, fold int"
    ).cache()


def predictions(spark, rows):
    return spark.createDataFrame(
        rows, "fold int, entity string, seg long, label int, p0 double, p1 double, prediction int"
    )


def weights(spark, strategy, probs):
    rows = [(0, "e", i, 1, 1 - p, p, int(p > 0.5)) for i, p in enumerate(probs)]
    placed = voting.with_segment_positions(predictions(spark, rows))
    out = placed.orderBy("seg").select(voting.segment_weight(strategy).alias("w")).collect()
    return [r["w"] for r in out]


@pytest.mark.parametrize(
    "strategy, probs, want",
    [
        ("late_segments", [0.6], [0.5]),
        ("late_segments", [0.6] * 3, [0.5, 1, 1.5]),
        ("early_segments", [0.6] * 3, [1.5, 1, 0.5]),
        ("last_0_segments", [0.6] * 4, [1, 1, 1, 1]),
        ("last_2_segments", [0.6] * 4, [0, 0, 1, 1]),
        ("last_2_segments_confidence", [0.6, 0.3, 0.2], [0, 0.7, 0.8]),
        ("late_segments_confidence", [0.6, 0.3], [0.3, 1.05]),
        ("confidence", [0.6, 0.3], [0.6, 0.7]),
        ("anything else", [0.6, 0.3], [1, 1]),
    ],
)
def test_weights(spark, strategy, probs, want):
    assert weights(spark, strategy, probs) == pytest.approx(want)


def test_a_tie_is_class_0(spark):
    rows = [(0, "e", 0, 1, 0.4, 0.6, 1), (0, "e", 1, 1, 0.6, 0.4, 0)]
    row = voting.entity_votes(predictions(spark, rows), "uniform").first()
    assert (row["predicted"], row["confidence"], row["correct"]) == (0, 0.5, False)


def test_only_whole_groups_vote(spark):
    rows = [(0, f"e{i:02d}", 0, 1, 0.2, 0.8, int(i != 3)) for i in range(12)]
    groups = voting.group_votes(predictions(spark, rows)).orderBy("chunk").collect()
    assert len(groups) == 2
    assert groups[0]["individual_preds"] == [1, 1, 1, 0, 1]
    assert groups[0]["group_confidence"] == pytest.approx(0.8)


def test_auc_with_ties_and_zero_guards(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 5, 80) / 5, rng.integers(0, 2, 80)
    df = spark.createDataFrame(
        [(float(a), int(b), 0) for a, b in zip(s, y)], "s double, y int, p int"
    )
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert evaluation.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(want)
    row = evaluation.outcome_counts(df, [], "y", "p").select(*evaluation.metric_columns()).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0, 0, 0)


def test_oversampling_reaches_parity_inside_the_hull(separable):
    out = balance.smote(separable, k=5).cache()
    sizes = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes[0] == sizes[1] == 180
    assert out.select("id").distinct().count() == out.count()
    given = np.array([r["vec"] for r in separable.where("label = 1").collect()])
    made = [r["vec"] for r in out.where("synthetic").collect()]
    near = []
    for point in made:
        # on a segment between a row and one of its five nearest
        best = np.inf
        for i, a in enumerate(given):
            order = np.argsort(((given - a) ** 2).sum(1))[1:6]
            for b in given[order]:
                u = np.clip(np.dot(point - a, b - a) / np.dot(b - a, b - a), 0, 1)
                best = min(best, np.abs(a + u * (b - a) - point).max())
        near.append(best)
    assert max(near) < 1e-9


def test_oversampling_with_copies(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(30)] + [(100 + i, 1, [1.0, 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    made = balance.smote(df).where("synthetic").collect()
    assert len(made) == 22 and all(r["vec"] == [1.0, 1.0] for r in made)


def test_held_out_predictions(separable):
    out = classifiers.cross_validated(separable, "LogisticRegression", range(3), maxIter=20)
    assert out.count() == separable.count()
    assert out.select("id").distinct().count() == separable.count()
    for row in classifiers.fold_metrics(out).collect():
        assert row["auc"] > 0.9
    assert classifiers.overall_metrics(out).first()["auc"] > 0.9


def test_unknown_model():
    with pytest.raises(ValueError):
        classifiers.classifier("KNN", 3)


def test_importance_finds_the_shifted_feature(separable):
    model = classifiers.fit(separable, "Random Forest", numTrees=10, maxDepth=4)
    names = ["shifted", "noise1", "noise2"]
    assert classifiers.feature_importance(model, names)[0][0] == "shifted"
    rows = importance.permutation_importance(model, separable, names, repeats=2).collect()
    assert rows[0]["feature"] == "shifted" and rows[0]["perm_importance"] > 0.1
    assert len(rows) == 3


def test_model_round_trip(separable, tmp_path):
    model = classifiers.fit(separable, "Limited Random Forest", numTrees=5)
    classifiers.save_model(model, str(tmp_path), ["a", "b", "c"], 5)
    loaded, names, threshold = classifiers.load_model(str(tmp_path))
    assert (names, threshold) == (["a", "b", "c"], 5)
    first = classifiers.score(model, separable).orderBy("id").select("p1").collect()
    assert classifiers.score(loaded, separable).orderBy("id").select("p1").collect() == first


def test_projection_against_eigenvalues(separable):
    _, shares = projection.principal_components(separable)
    x = np.array([r["vec"] for r in separable.collect()])
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert shares == pytest.approx((values / values.sum())[:2].tolist(), rel=1e-6)


def test_median_fill_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (2.0, 5.0), (9.0, 5.0)], "a double, b double")
    filled = [r["a"] for r in impute.impute_medians(df, ["a", "b"]).collect()]
    assert sorted(filled) == [1, 2, 2, 9]
    scaled = impute.standardize(df.where("a is not null"), ["a", "b"]).collect()
    assert np.std([r["a"] for r in scaled]) == pytest.approx(1) and {r["b"] for r in scaled} == {0}
    ordered = impute.model_columns(df, ["b", "zz"]).select("b", "zz").first()
    assert tuple(ordered) == (5.0, 0.0)


def test_threshold_choice(spark):
    df = spark.createDataFrame(
        [(1, 0.03, 0.9, 0.8, 0.7, 0.2), (5, 0.1, 0.85, 0.8, 0.9, 0.5), (10, 0.14, 0.85, 0.7, 0.6, 0.6)],
        "threshold int, positive_rate double, cv_auc_mean double, test_auc double, "
        "test_accuracy double, test_f1 double",
    )
    assert tuple(choice.best_thresholds(df).first()) == (1, 1, 5, 10, 5)


def test_smallest_best_feature_count(spark):
    df = spark.createDataFrame([(1, 0.6), (3, 0.8), (5, 0.8)], "n_features int, mean_auc double")
    row = importance.best_feature_count(df).first()
    assert (row["n_features"], row["gain"]) == (3, pytest.approx(0.2))


def test_predictor_job(spark):
    rng = np.random.default_rng(11)
    rows = [
        (e, s, 0, float(s - 12 + rng.normal()), None if s == 3 else float(rng.normal()))
        for e in range(15) for s in range(12)
    ]
    segments = spark.createDataFrame(
        rows, "entity long, seg long, label int, mean_speed double, other double"
    )
    prepared, names = predictor.prepare(segments, 2, use_top_features=False)
    assert names == ["mean_speed", "other"]
    assert prepared.where("label = 1").count() == 15 * 3
    model, held_out = predictor.train_and_evaluate(
        prepared, "RandomForest", 3, use_smote=True, numTrees=10, maxDepth=4
    )
    assert classifiers.overall_metrics(held_out).first()["auc"] > 0.8
    risk = predictor.predict_risk(model, names, segments.drop("other"))
    assert risk.where("p1 between 0 and 1").count() == 180


def test_entity_blocks_of_names_stay_bounded(spark):
    from pathpulse.operators.voting import entity_block

    rows = [(0, 1, f"coordinates_highestspeed_20240827_{k:05d}_1") for k in range(500)]
    df = spark.createDataFrame(rows, "fold int, label int, entity string")
    blocks = df.groupBy(entity_block(df, most=50).alias("b")).count()
    assert blocks.agg({"count": "max"}).first()[0] <= 50
    assert df.groupBy(entity_block(df).alias("b")).count().count() == 1


def test_trials_side_by_side_equal_single_fits(separable):
    table = classifiers.matrix(separable)
    fold = F.col("fold")
    trials = [
        classifiers.Trial("LogisticRegression", fold != 0, fold == 0, overrides={"maxIter": 20}),
        classifiers.Trial("LogisticRegression", fold != 1, fold == 1, positions=(1, 2), overrides={"maxIter": 20}),
        classifiers.Trial("LogisticRegression", fold != 2, fold == 2, 1 - F.col("label"), overrides={"maxIter": 20}),
    ]
    models, predicted = classifiers.side_by_side(table, trials)
    got = {(r["trial"], r["id"]): (r["label"], r["p1"]) for r in predicted.collect()}
    assert len(got) == separable.count() and len(models) == 3
    kept = F.array(F.get("vec", 1), F.get("vec", 2))
    for i, (rows, features, label) in enumerate((("fold <> 0", F.col("vec"), F.col("label")), ("fold <> 1", kept, F.col("label")), ("fold <> 2", F.col("vec"), 1 - F.col("label")))):
        data = separable.withColumns({"vec": features, "label": label})
        model = classifiers.fit(data.where(rows), "LogisticRegression", maxIter=20)
        for r in classifiers.score(model, data.where(rows.replace("<>", "="))).collect():
            assert got[i, r["id"]] == (r["label"], pytest.approx(r["p1"], abs=1e-9))


def test_oversampled_trials_take_made_rows_of_their_own_part(separable):
    table = classifiers.matrix(separable)
    trials = [classifiers.Trial("LogisticRegression", F.col("fold") != k, F.col("fold") == k) for k in range(3)]
    counts = classifiers._class_counts(table, trials)
    made = classifiers._oversampled(table, trials, counts).collect()
    rows = separable.collect()
    for k in range(3):
        sizes = [sum(r["fold"] != k and r["label"] == c for r in rows) for c in (0, 1)]
        assert counts[k] == dict(enumerate(sizes))
        mine = [r for r in made if r["group"] == k]
        assert len(mine) == sizes[0] - sizes[1] and {r["label"] for r in mine} == {1}
        given = np.array([r["vec"] for r in rows if r["fold"] != k and r["label"] == 1])
        low, high = given.min(0), given.max(0)
        assert all((low <= r["vec"]).all() and (r["vec"] <= high).all() for r in mine)


def test_neighbours_of_many_groups_at_once(spark):
    rng = np.random.default_rng(4)
    rows = [(g, k, rng.integers(0, 4, 2).astype(float).tolist()) for g in range(3) for k in range(40 * g + 3)]
    near = nearest_in_groups(spark.createDataFrame(rows, "group int, id long, vec array<double>"), 3, block_rows=7).collect()
    for g in range(3):
        first = {}
        for _, k, v in sorted(r for r in rows if r[0] == g):
            first.setdefault(tuple(v), k)
        got = {r["id"]: [x["id"] for x in r["nn"]] for r in near if r["group"] == g}
        assert sorted(got) == sorted(first.values())
        for v, k in first.items():
            others = sorted((math.dist(v, w), j) for w, j in first.items() if j != k)
            assert got[k] == [j for _, j in others[:3]]


def test_stored_run_of_the_predictor(spark, tmp_path):
    """Metrics are held against SQL over the stored predictions."""
    rng = np.random.default_rng(12)
    rows = [(e, s, e % 2, float(s - 12 + 2 * rng.normal()), float(rng.normal())) for e in range(15) for s in range(12)]
    segments = spark.createDataFrame(rows, "entity long, seg long, label int, mean_speed double, std_speed double")
    path = str(tmp_path / "run")
    results = predictor.run_predictor(segments, path, 2, k=3, numTrees=10, maxDepth=4)
    con = duckdb.connect()
    for name in ("predictions", "risks"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}/*.parquet'")
    assert con.execute("SELECT count(*), count(DISTINCT id), count(DISTINCT fold) FROM predictions").fetchone() == (180, 180, 3)
    metric = """count(*) FILTER (prediction = label) / count(*) AS accuracy,
      (SELECT avg(CASE WHEN a.p1 > b.p1 THEN 1 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0 END) FROM {0} a, {0} b
       WHERE a.label = 1 AND b.label = 0{1}) AS auc,
      2 * count(*) FILTER (prediction = 1 AND label = 1) / (count(*) FILTER (prediction = 1) + count(*) FILTER (label = 1)) AS f1"""
    per_fold = con.execute(
        f"SELECT p.fold, {metric.format('predictions', ' AND a.fold = p.fold AND b.fold = p.fold')} FROM predictions p GROUP BY p.fold ORDER BY 1"
    ).fetchall()
    got = [(r["fold"], r["accuracy"], r["auc"], r["f1"]) for r in results["cv"].orderBy("fold").collect()]
    for a, b in zip(got, per_fold, strict=True):
        assert a == pytest.approx(b)
    whole = con.execute(f"SELECT {metric.format('risks', '')} FROM risks").fetchone()
    row = results["evaluation"].first()
    assert (row["accuracy"], row["auc"], row["f1"]) == pytest.approx(whole)
    stages = con.execute("""SELECT ceil(seg / 11.0 * 5) AS stage, avg(p1), stddev_samp(p1), count(*) FROM risks WHERE seg > 0
      GROUP BY 1 ORDER BY 1""").fetchall()
    got = [(r["life_stage"], r["mean"], r["std"], r["n"]) for r in results["stages"].orderBy("life_stage").collect()]
    for a, b in zip(got, stages, strict=True):
        assert a == pytest.approx(b)
    loaded, names, threshold = classifiers.load_model(path)
    assert (names, threshold) == (["mean_speed", "std_speed"], 2)
    again = {r["id"]: r["p1"] for r in classifiers.score(loaded, predictor.prepare(segments, 2)[0]).collect()}
    assert {r["id"]: r["p1"] for r in results["risks"].collect()} == pytest.approx(again)


def test_thresholds_are_compared_on_one_matrix(spark):
    rng = np.random.default_rng(13)
    rows = [(e, s, e % 2, float(s - 12 + rng.normal())) for e in range(20) for s in range(12)]
    segments = spark.createDataFrame(rows, "entity long, seg long, label int, mean_speed double")
    got = {r["threshold"]: r for r in predictor.compare_thresholds(segments, (1, 3, 20), k=3, numTrees=8, maxDepth=4).collect()}
    assert got[1]["positive_samples"] == 40 and got[3]["positive_samples"] == 80 and got[20]["negative_samples"] == 0
    assert got[1]["cv_auc_mean"] > 0.8 and got[3]["test_auc"] > 0.9 and got[20]["cv_auc_mean"] is None
    assert got[1]["total_features"] == 1


def test_quick_test_takes_the_best_features(separable):
    row = importance.quick_feature_test(separable, ["shifted", "noise1", "noise2"], range(3), n_features=1).first()
    assert row["features"] == ["shifted"] and row["mean_auc"] > 0.9


def test_permutation_equals_a_plain_shuffle(separable):
    """A feature the model does not use loses nothing; the others lose what numpy's shuffle loses, within its spread."""
    model = classifiers.fit(separable, "LogisticRegression", maxIter=20)
    got = {r["feature"]: r for r in importance.permutation_importance(model, separable, ["a", "b", "c"], repeats=20).collect()}
    rows = separable.collect()
    x, y = np.array([r["vec"] for r in rows]), np.array([r["label"] for r in rows])
    scaler, line = model.stages
    weights = line.coefficients.toArray() / scaler.std.toArray()
    bias = line.intercept - (weights * scaler.mean.toArray()).sum()
    hit = lambda m: (((m @ weights + bias) > 0) == y).mean()
    rng = np.random.default_rng(1)
    for i, name in enumerate("abc"):
        drops = []
        for _ in range(200):
            m = x.copy()
            m[:, i] = rng.permutation(m[:, i])
            drops.append(hit(x) - hit(m))
        assert abs(got[name]["perm_importance"] - np.mean(drops)) < 4 * np.std(drops) / 20**0.5 + 1e-3


@pytest.fixture(scope="module")
def walks(spark, tmp_path_factory):
    """A folder with events of 12 users, 64 each and none missing: two segments of 32 frames a user."""
    folder = tmp_path_factory.mktemp("walks")
    rng = np.random.default_rng(3)
    rows = [
        (u * 64 + i, f"2024-01-01 00:{i:02d}:00" if i < 60 else f"2024-01-01 01:{i - 60:02d}:00", u, "view", float(rng.uniform(1, 100)), f'{{"k": {rng.integers(1, 100)}}}')
        for u in range(12) for i in range(64)
    ]
    events = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string, value double, props string")
    events.select("event_id", F.to_timestamp("at").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_published_features_have_whole_meandering_windows(spark, walks):
    rows = models.published_rows(spark, walks).collect()
    assert len(rows) == 24
    # the ratios, then the fractal dimension and the deepest wavelet level, which need long segments too
    assert all(r["vec"][i] > 0 for r in rows for i in (0, 1, 2, 9)) and all(r["vec"][8] != 0 for r in rows)
    assert all(r["vec"][2] < r["vec"][1] for r in rows)  # more than one window each


def test_sequences_of_whole_segments_are_frames_and_not_padding(spark, walks):
    rows = models.sequence_rows(spark, walks).collect()
    assert len(rows) == 24 and {len(r["vec"]) for r in rows} == {4 * 32}
    assert all(v > 0 for r in rows for v in r["vec"][0::4])  # x of every point
    assert len({v for r in rows for v in r["vec"][0::4]}) == 24 * 32
