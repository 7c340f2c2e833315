"""First against last part of life: every statistic of a feature in one row, and its rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathpulse.functions.pvalues import t_p_value
from pathpulse.operators import hypothesis as h
from pathpulse.operators.labels import first_and_last, halves_by_percentage
from pathpulse.operators.longview import to_long
from pathpulse.operators.ordered import exact_quantiles
from pathpulse.operators.trends import percentage_change


def compare_parts(df: DataFrame, features: Sequence[str], part: str = "part") -> DataFrame:
    """21 statistics per feature between rows marked ``first`` and ``last``."""
    pair = h.two_groups(h.group_moments(df, features, part), part, "first", "last")
    long = to_long(df, [part], features).where(F.col("value").isNotNull())
    medians = (
        exact_quantiles(long, ["feature", part], "value", [0.5])
        .groupBy("feature")
        .agg(
            F.max(F.when(F.col(part) == "first", F.get("q", 0))).alias("first_median"),
            F.max(F.when(F.col(part) == "last", F.get("q", 0))).alias("last_median"),
        )
    )
    t, freedom = h.welch_t()
    u = h.mann_whitney(df, features, part, "first", "last").select(
        "feature", F.col("u").alias("mannwhitney_u"), F.col("p_value").alias("mannwhitney_p_value")
    )
    spread = h.levene(df, features, part).select(
        "feature", F.col("f").alias("levene_statistic"), F.col("p_value").alias("levene_p")
    )
    joined = (
        pair.where((F.col("n1") > 0) & (F.col("n2") > 0))
        .withColumns({"t_statistic": t, "_df": freedom, "effect_size_cohens_d": h.cohens_d()})
        .withColumn("t_p_value", t_p_value("t_statistic", "_df"))
        .join(medians, "feature")
        .join(u, "feature")
        .join(spread, "feature")
    )
    return joined.select(
        "feature",
        F.col("mean1").alias("first_mean"),
        F.col("mean2").alias("last_mean"),
        F.sqrt("var1").alias("first_std"),
        F.sqrt("var2").alias("last_std"),
        "first_median",
        "last_median",
        (F.col("mean2") - F.col("mean1")).alias("absolute_difference"),
        percentage_change(F.col("mean1"), F.col("mean2")).alias("percentage_change"),
        "effect_size_cohens_d",
        h.effect_class(F.col("effect_size_cohens_d")).alias("effect_interpretation"),
        "t_statistic",
        "t_p_value",
        "mannwhitney_u",
        "mannwhitney_p_value",
        "levene_statistic",
        "levene_p",
        F.coalesce(F.col("t_p_value") < 0.05, F.lit(False)).alias("t_significant"),
        F.coalesce(F.col("mannwhitney_p_value") < 0.05, F.lit(False)).alias(
            "mannwhitney_significant"
        ),
        F.coalesce(F.col("levene_p") > 0.05, F.lit(True)).alias("variance_equal"),
        F.col("n1").alias("n_first"),
        F.col("n2").alias("n_last"),
    )


DEFINITIONS = ("percentage", "absolute")


def first_against_last(
    segments: DataFrame, features: Sequence[str], definition: str = "percentage", threshold: int = 50
) -> DataFrame:
    """Compare the first with the last part of life: up to ``threshold`` percent of it against the rest, or the
    first against the last ``threshold`` segments of entities that have more than twice as many."""
    if definition not in DEFINITIONS:
        raise ValueError(f"unknown definition: {definition}; known: {DEFINITIONS}")
    parts = (
        halves_by_percentage(segments, threshold) if definition == "percentage" else first_and_last(segments, threshold)
    )
    return compare_parts(parts, features)


def ranked(results: DataFrame) -> DataFrame:
    """Four 1-based rankings of the features; the table has one row per feature."""
    size = F.abs("effect_size_cohens_d")
    p = F.coalesce("t_p_value", F.lit(1.0))
    combined = F.coalesce(size, F.lit(0.0)) * -F.log10(F.greatest(p, F.lit(1e-10)))
    scored = results.withColumn("combined_score", combined)

    def place(order: Column) -> Column:
        return F.row_number().over(Window.orderBy(order, "feature"))

    return scored.withColumns(
        {
            "rank_effect_size": place(F.desc(F.coalesce(size, F.lit(0.0)))),
            "rank_percentage_change": place(
                F.desc(F.coalesce(F.abs("percentage_change"), F.lit(0.0)))
            ),
            "rank_p_value": place(F.asc(p)),
            "rank_combined": place(F.desc("combined_score")),
        }
    ).orderBy("rank_combined")


def summary_counts(results: DataFrame) -> DataFrame:
    """How many features are significant, and how large their effects and changes are."""
    size, change = F.abs("effect_size_cohens_d"), F.abs("percentage_change")
    counts = {
        "features": F.count(F.lit(1)),
        "t_significant": F.count_if("t_significant"),
        "mannwhitney_significant": F.count_if("mannwhitney_significant"),
        "large_effect": F.count_if(size >= 0.8),
        "medium_effect": F.count_if((size >= 0.5) & (size < 0.8)),
        "small_effect": F.count_if((size >= 0.2) & (size < 0.5)),
        "negligible_effect": F.count_if(size < 0.2),
        "change_over_100": F.count_if(change > 100),
        "change_50_to_100": F.count_if((change > 50) & (change <= 100)),
        "change_20_to_50": F.count_if((change > 20) & (change <= 50)),
    }
    return results.agg(*[c.alias(name) for name, c in counts.items()])
