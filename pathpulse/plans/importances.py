"""Which features matter: five scores, their combination, and how many features are enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.operators import hypothesis, importance
from pathpulse.session import cut_lineage
from pathpulse.sources.stores import write_csv, write_table


def score_features(
    segments: DataFrame, features: Sequence[str], repeats: int = 10, **overrides
) -> DataFrame:
    """Combined importance per feature of ``segments(entity, seg, label, features…)``."""
    names = list(features)
    rows = cut_lineage(model_rows(segments, names))
    forest = importance.forest_importance(rows, names, **overrides)
    shuffled = importance.forest_permutation_importance(rows, names, repeats, **{"numTrees": 50, **overrides})
    return importance.combine_scores(forest, shuffled, statistical_scores(segments, names))


def statistical_scores(segments: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """``(feature, f_score, mutual_info, abs_correlation)`` against the label."""
    correlation = hypothesis.pearson(segments, features, label).select("feature", F.col("abs_r").alias("abs_correlation"))
    return (
        hypothesis.anova(hypothesis.group_moments(segments, features, label))
        .select("feature", F.col("f").alias("f_score"))
        .join(hypothesis.binned_mutual_information(segments, features, label), "feature")
        .join(correlation, "feature")
    )


def model_rows(segments: DataFrame, names: Sequence[str]) -> DataFrame:
    return segments.select(
        F.xxhash64("entity", "seg").alias("id"), "entity", "seg", "label",
        F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).alias("vec"),
    )


def sweep_subsets(
    segments: DataFrame, scores: DataFrame, k: int = 5, max_features: int | None = None, **overrides
) -> DataFrame:
    """Held-out AUC with the best 1, 3, 5, … features by combined score, up to all of them."""
    from pathpulse.operators.folds import with_folds

    # a row per feature
    ranked = [r["feature"] for r in scores.orderBy(F.desc("combined_score"), "feature").collect()]
    rows = cut_lineage(with_folds(model_rows(segments, ranked), k))
    counts = range(1, min(max_features or len(ranked), len(ranked)) + 1, 2)
    return importance.subset_performance(
        rows, range(len(ranked)), range(k), counts, **{"numTrees": 50, **overrides}
    )


def importance_job(
    segments: DataFrame, path: str, features: Sequence[str], top: int = 20, k: int = 5, max_features: int = 50, **overrides
) -> dict[str, DataFrame]:
    """Write all scores, the ``top`` ones, the subset sweep and its choice as CSV and tables; return the tables."""
    spark = segments.sparkSession
    write_table(score_features(segments, features, **overrides), f"{path}/all_features")
    scores = spark.read.parquet(f"{path}/all_features")
    best = scores.orderBy(F.desc("combined_score"), "feature").limit(top)
    write_table(sweep_subsets(segments, scores, k, max_features, **overrides), f"{path}/performance")
    sweep = spark.read.parquet(f"{path}/performance")
    tables = {"all_features": scores, "top_features": best, "performance": sweep, "choice": importance.best_feature_count(sweep)}
    for name, order in (("all_features", F.desc("combined_score")), ("top_features", F.desc("combined_score")), ("performance", F.asc("n_features"))):
        # a row per feature or size: one file keeps their order
        write_csv(tables[name].coalesce(1).sortWithinPartitions(order), f"{path}/{name}_csv")
    return tables
