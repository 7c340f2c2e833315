from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathpulse.functions.pvalues import fisher_upper, normal_two_sided, rank_sum_two_sided, student_two_sided
from pathpulse.operators import bins, describe, folds, hypothesis, labels, trends
from pathpulse.operators.compare import ranked
from pathpulse.operators.longview import feature_columns, varying_features


# Tabulated probabilities.
@pytest.mark.parametrize(
    "got, want",
    [
        (student_two_sided(12.706204736, 1), 0.05),
        (student_two_sided(2.228138852, 10), 0.05),
        (student_two_sided(1.959963985, 1e9), 0.05),
        (student_two_sided(-2.0, 2), 0.18350341907227397),
        (fisher_upper(4.964602744, 1, 10), 0.05),
        (fisher_upper(3.098391225, 3, 20), 0.05),
        (fisher_upper(0.0, 3, 20), 1.0),
        (normal_two_sided(1.959963984540054), 0.05),
        (normal_two_sided(0), 1.0),
    ],
)
def test_tail_probabilities(got, want):
    assert got == pytest.approx(want, rel=1e-7)


def test_missing_statistics_have_no_probability():
    assert math.isnan(student_two_sided(math.nan, 3)) and math.isnan(fisher_upper(1, 0, 3))


def segments(spark, counts):
    rows = [(e, s, e % 2, float(s)) for e, n in counts.items() for s in range(n)]
    return spark.createDataFrame(rows, "entity long, seg long, label int, v double")


def test_both_label_rules(spark):
    df = segments(spark, {1: 10})
    strict = labels.close_to_death(df, 3).where("death_close = 1")
    loose = labels.close_to_death(df, 3, inclusive=True).where("death_close = 1")
    assert sorted(r["seg"] for r in strict.collect()) == [7, 8, 9]
    assert sorted(r["seg"] for r in loose.collect()) == [6, 7, 8, 9]
    kept = labels.first_segments(df, 5, "death_proximity", 2).where("label = 1")
    assert sorted(r["seg"] for r in kept.collect()) == [3, 4]
    with pytest.raises(ValueError):
        labels.labelled(df, "nonsense")


def test_strict_labels_count(spark):
    sizes = {1: 10, 2: 2, 3: 1, 4: 7}
    marked = labels.close_to_death(segments(spark, sizes), 5)
    assert marked.agg(F.sum("death_close")).first()[0] == sum(min(5, n) for n in sizes.values())


def test_first_and_last_need_more_than_twice(spark):
    out = labels.first_and_last(segments(spark, {1: 10, 2: 4, 3: 5}), 2)
    got = sorted((r["entity"], r["part"], r["seg"]) for r in out.collect())
    assert got == [
        (1, "first", 0), (1, "first", 1), (1, "last", 8), (1, "last", 9),
        (3, "first", 0), (3, "first", 1), (3, "last", 3), (3, "last", 4),
    ]


def test_life_bins(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (20.1,), (80.0,), (100.0,)], "p double")
    rows = df.select(labels.life_bin(F.col("p")), labels.end_of_life_bin(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(None, None), (1, None), (2, None), (4, None), (5, 4)]


def test_equal_width_and_frequency_bins(spark):
    def binned(values, counts):
        df = spark.createDataFrame([(float(v), 0) for v in values], "value double, label int")
        rows = counts(df, ["value"], "label").orderBy("bin").collect()
        return [(r["bin"], r["n"]) for r in rows]

    assert binned([0.0, 1, 2, 10], bins.equal_width_counts) == [(1, 3), (5, 1)]
    assert binned([3.0, 3.0], bins.equal_width_counts) == [(3, 2)]
    assert binned([0.0, 0, 0, 1, 2, 10], bins.equal_frequency_counts) == [(1, 4), (2, 1), (3, 1)]
    assert binned([2.0, 2, 2], bins.histogram_by_label) == [(10, 3)]


def test_folds_keep_entities_together_and_balanced(spark):
    df = segments(spark, {e: 3 for e in range(40)})
    out = folds.with_folds(df, 5)
    assert out.count() == df.count()
    assert out.select("entity", "fold").distinct().count() == 40
    sizes = out.groupBy("fold", "label").agg(F.countDistinct("entity").alias("n")).collect()
    assert {r["n"] for r in sizes} == {4} and len(sizes) == 10


def test_rank_test_against_pair_counts(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 30), rng.integers(2, 11, 25)
    df = spark.createDataFrame(
        [(float(v), 0) for v in a] + [(float(v), 1) for v in b], "v double, g int"
    )
    row = hypothesis.mann_whitney(df, ["v"], "g", 0, 1).first()
    want = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert row["u"] == want and 0 < row["p_value"] < 0.05


def test_missing_values_are_skipped(spark):
    df = spark.createDataFrame(
        [(1.0, 0), (3.0, 0), (None, 0), (2.0, 1), (6.0, 1), (None, 1)], "v double, g int"
    )
    pair = hypothesis.two_groups(hypothesis.group_moments(df, ["v"], "g"), "g", 0, 1)
    row = pair.withColumn("d", hypothesis.cohens_d()).first()
    assert (row["n1"], row["mean1"], row["mean2"]) == (2, 2.0, 4.0)
    assert row["d"] == pytest.approx(-2 / math.sqrt(5))


def test_constant_groups_have_no_effect(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (1.0, 1), (1.0, 1)], "v double, g int")
    pair = hypothesis.two_groups(hypothesis.group_moments(df, ["v"], "g"), "g", 0, 1)
    t, _ = hypothesis.welch_t()
    row = pair.select(hypothesis.cohens_d().alias("d"), t.alias("t")).first()
    assert (row["d"], row["t"]) == (0.0, None)


def test_trend_edges(spark):
    def fit(points, min_bins=3):
        df = spark.createDataFrame(
            [("f", b, v) for b, v in points], "feature string, bin int, mean double"
        )
        return trends.linear_trends(df, min_bins=min_bins).first()

    assert fit([(1, 1.0), (2, 2.0)]) is None
    line = fit([(1, 1.0), (2, 2.0), (4, 4.0)])
    assert line["slope"] == pytest.approx(0.05) and line["p_value"] == pytest.approx(0, abs=1e-6)
    flat = fit([(1, 2.0), (2, 2.0), (3, 2.0)])
    assert (flat["r_squared"], flat["p_value"], flat["trend_direction"]) == (0, 1, "decreasing")
    two = fit([(1, 1.0), (2, 3.0)], 2)
    assert two["p_value"] == 0 and two["percentage_change"] == pytest.approx(200)


def test_metadata_is_not_a_feature(spark):
    df = spark.createDataFrame(
        [(1, 2, 0, 0.5, 3, "a")], "entity long, seg long, label int, v double, k int, filename string"
    )
    assert feature_columns(df) == ["v", "k"]
    assert not varying_features(df, ["v"]).first()["varies"]


def test_rankings(spark):
    df = spark.createDataFrame(
        [("a", 0.5, 10.0, 0.01), ("b", -0.9, None, None), ("c", 0.1, -50.0, 1e-30)],
        "feature string, effect_size_cohens_d double, percentage_change double, t_p_value double",
    )
    got = {r["feature"]: r for r in ranked(df).collect()}
    assert [got[f]["rank_effect_size"] for f in "abc"] == [2, 1, 3]
    assert [got[f]["rank_percentage_change"] for f in "abc"] == [2, 3, 1]
    assert [got[f]["rank_p_value"] for f in "abc"] == [2, 3, 1]
    assert got["c"]["combined_score"] == pytest.approx(1.0)
    assert got["b"]["combined_score"] == 0


@pytest.mark.parametrize("df, known", [(1e10, 0.0455002639234), (1e12, 0.0455002638964)])
def test_student_tail_keeps_its_digits_on_many_rows(df, known):
    assert abs(student_two_sided(2.0, df) - known) < 1e-12
    # both ways agree where they meet
    a, b = student_two_sided(1.5, 1e6), student_two_sided(1.5, 1e6 + 1)
    assert abs(a - b) < 1e-10


def _all_ways(n1, n2, u):
    """Share of all ways to deal out the ranks with a U at least as far from the middle."""
    far = abs(u - n1 * n2 / 2)
    sums = [sum(c) - n1 * (n1 - 1) / 2 for c in itertools.combinations(range(n1 + n2), n1)]
    return sum(abs(s - n1 * n2 / 2) >= far - 1e-9 for s in sums) / len(sums)


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 9), (2, 5), (8, 8), (4, 11), (7, 3)])
def test_exact_rank_sum_probabilities(n1, n2):
    for u in range(n1 * n2 + 1):
        assert abs(rank_sum_two_sided(n1, n2, u) - min(1.0, _all_ways(n1, n2, u))) < 1e-12


def test_rank_sums_beside_a_large_sample(monkeypatch):
    exact = {u: rank_sum_two_sided(8, 200_000, u) for u in (100_000, 300_000, 790_000)}
    monkeypatch.setattr("pathpulse.functions.pvalues.MOST_COUNTS", 10)
    for u, p in exact.items():
        assert rank_sum_two_sided(8, 200_000, u) == pytest.approx(p, rel=1e-8)
    assert math.isnan(rank_sum_two_sided(0, 5, 0))


def test_exact_and_normal_branch_in_one_table(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 2, float(v) if k < 12 else None, float(round(v, 1)), float(v), None if k % 2 else float(v)) for k, v in enumerate(rng.standard_normal(60))]
    df = spark.createDataFrame(rows, "g int, few double, ties double, many double, one_sided double")
    got = {r["feature"]: r for r in hypothesis.mann_whitney(df, ["few", "ties", "many", "one_sided"], "g", 0, 1).collect()}
    assert {f: r["method"] for f, r in got.items()} == {"few": "exact", "ties": "normal", "many": "normal", "one_sided": "exact"}
    assert abs(got["few"]["p_value"] - _all_ways(6, 6, got["few"]["u"])) < 1e-12
    assert got["one_sided"]["p_value"] is None


def test_feature_statistics_travel_as_literals(spark):
    """The long rows are never shuffled to meet their feature's range, edges, medians or ranks."""
    rng = np.random.default_rng(5)
    rows = [(int(k % 3), *map(float, rng.standard_normal(2))) for k in range(300)]
    df = spark.createDataFrame(rows, "label int, a double, b double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        made = {
            "width": bins.equal_width_counts(df, ["a", "b"], "label"),
            "frequency": bins.equal_frequency_counts(df, ["a", "b"], "label"),
            "histogram": bins.histogram_by_label(df, ["a", "b"], "label"),
            "spread": hypothesis.levene(df, ["a", "b"], "label"),
            "ranks": hypothesis.spearman(df, ["a", "b"], "label"),
            "box": describe.box_statistics(df, ["a", "b"], "label"),
        }
        for name, table in made.items():
            plan = table._jdf.queryExecution().optimizedPlan().toString()
            for line in plan.split("\n"):
                # what is joined is a row per feature (and class)
                assert "Join" not in line or name in ("spread", "box"), (name, line)
            assert table.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_labels_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(v), float(w)) for v, w in zip(rng.integers(0, 40, 200), rng.standard_normal(200))]
    df = spark.createDataFrame(rows, "label int, a double")
    one = hypothesis.spearman(df, ["a"], "label").first()["rho"]
    monkeypatch.setattr(hypothesis, "LABELS_IN_PLAN", 5)
    assert hypothesis.spearman(df, ["a"], "label").first()["rho"] == pytest.approx(one, abs=1e-12)
