"""Comparison of the two conditions: effects, their ranking and the scaled means of the largest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pathpulse.operators import describe, hypothesis
from pathpulse.operators.longview import feature_columns, varying_features


def usable_features(df: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """Features that vary; a row per feature comes back."""
    names = list(features or feature_columns(df))
    kept = varying_features(df, names).where("varies").collect()
    return [n for n in names if n in {row["feature"] for row in kept}]


def compare_conditions(
    df: DataFrame, features: Sequence[str] | None = None, top: int = 8
) -> dict[str, DataFrame]:
    names = usable_features(df, features)
    effects = hypothesis.effect_sizes(df, names, "label", 0, 1)
    largest = [row["feature"] for row in effects.limit(top).collect()]
    return {
        "effects": effects,
        "radar": describe.normalized_means(df, largest, "label"),
        "correlations": hypothesis.correlations(df, names, "label"),
        "anova": hypothesis.anova(hypothesis.group_moments(df, names, "label")),
        "boxes": describe.box_statistics(df, names, "label"),
        "matrix": describe.correlation_matrix(df, [*names, "label"]),
    }
