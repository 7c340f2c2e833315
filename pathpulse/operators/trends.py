"""Change of features over the life of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.functions.pvalues import t_p_value
from pathpulse.operators.hypothesis import group_moments, pooled_t, two_groups
from pathpulse.operators.labels import end_of_life_bin, life_bin, with_life_percentage
from pathpulse.operators.longview import per_feature


def lower_edge(b: Column) -> Column:
    return ((b - 1) * 20).cast("double")


def centre(b: Column) -> Column:
    return (b * 20 - 10).cast("double")


def end_of_life_centre(b: Column) -> Column:
    return b * 5 + F.lit(77.5)


def with_life_bins(segments: DataFrame) -> DataFrame:
    life = with_life_percentage(segments)
    p = F.col("lifespan_percentage")
    return life.withColumns({"lifespan_bin": life_bin(p), "eol_bin": end_of_life_bin(p)})


def bin_means(
    binned: DataFrame, features: Sequence[str], bin_column: str, by: Sequence[str] = ()
) -> DataFrame:
    """Mean and standard error per feature and bin; rows outside all bins are left out."""
    return per_feature(
        binned.where(F.col(bin_column).isNotNull()),
        [*by, bin_column],
        features,
        {
            "mean": F.avg,
            "sem": lambda c: F.try_divide(F.stddev(c), F.sqrt(F.count(c).cast("double"))),
            "n": F.count,
        },
    ).withColumnRenamed(bin_column, "bin")


def percentage_change(first: Column, last: Column) -> Column:
    return F.try_divide(last - first, F.abs(first)) * 100


def linear_trends(
    means: DataFrame, x=lower_edge, by: Sequence[str] = (), min_bins: int = 3
) -> DataFrame:
    """Straight-line fit through the bin means of each feature.

    Equal means have no explained share; two points fit exactly.
    """
    points = means.where(F.col("mean").isNotNull()).withColumn("_x", x(F.col("bin")))
    fits = (
        points.groupBy(*by, "feature")
        .agg(
            F.count(F.lit(1)).alias("n_bins"),
            F.regr_slope("mean", "_x").alias("slope"),
            F.when(F.min("mean") == F.max("mean"), F.lit(0.0))
            .otherwise(F.regr_r2("mean", "_x"))
            .alias("r_squared"),
            F.min_by("mean", "bin").alias("early_mean"),
            F.max_by("mean", "bin").alias("late_mean"),
        )
        .where(F.col("n_bins") >= min_bins)
    )
    freedom = (F.col("n_bins") - 2).cast("double")
    t = F.sqrt(F.try_divide(freedom * F.col("r_squared"), 1 - F.col("r_squared")))
    p = (
        F.when(F.col("r_squared") >= 1, F.lit(0.0))
        .when(freedom == 0, F.when(F.col("r_squared") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.col("_p"))
    )
    return (
        fits.withColumn("_p", t_p_value(t, freedom))
        .withColumn("p_value", p)
        .withColumn("percentage_change", percentage_change(F.col("early_mean"), F.col("late_mean")))
        .withColumn(
            "trend_direction", F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
        )
        .drop("_p")
    )


def trend_scores(means: DataFrame, labels: Sequence[int], by: str = "label") -> DataFrame:
    """Slope, halved when not significant, per feature with one column per condition."""
    trends = linear_trends(means, centre, [by])
    score = F.col("slope") * F.when(F.col("p_value") < 0.05, 1.0).otherwise(0.5)
    return (
        trends.withColumn("score", score)
        .groupBy("feature")
        .pivot(by, list(labels))
        .agg(F.first("score"))
        .select("feature", *[F.col(str(v)).alias(f"condition_{v}") for v in labels])
    )


def significant_trends(
    trends: DataFrame, alpha: float = 0.05, min_r_squared: float = 0.1, n: int = 6
) -> DataFrame:
    return (
        trends.where((F.col("p_value") < alpha) & (F.col("r_squared") > min_r_squared))
        .orderBy("p_value", "feature")
        .limit(n)
    )


def part_changes(
    df: DataFrame, features: Sequence[str], part: str, first: str, last: str
) -> DataFrame:
    """Means, differences and the pooled t test between two parts of life.

    The effect is |t| over the root of all rows less two, rows with missing values included.
    """
    pair = two_groups(group_moments(df, features, part), part, first, last)
    rows = df.where(F.col(part).isin(first, last)).agg(F.count(F.lit(1)).alias("n_rows"))
    t, freedom = pooled_t()
    return (
        pair.withColumn("_one", F.lit(1))
        .join(rows.withColumn("_one", F.lit(1)), "_one")
        .withColumns({"t_statistic": t, "df": freedom})
        .withColumn("p_value", t_p_value("t_statistic", "df"))
        .select(
            "feature",
            F.col("mean1").alias("first_mean"),
            F.col("mean2").alias("last_mean"),
            (F.col("mean2") - F.col("mean1")).alias("absolute_difference"),
            percentage_change(F.col("mean1"), F.col("mean2")).alias("percentage_change"),
            "t_statistic",
            "p_value",
            F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"),
            (F.abs("t_statistic") / F.sqrt((F.col("n_rows") - 2).cast("double"))).alias(
                "effect_size"
            ),
        )
    )


def early_and_late(life: DataFrame, low: float = 20, high: float = 80) -> DataFrame:
    p = F.col("lifespan_percentage")
    part = F.when(p <= low, "early").when(p >= high, "late")
    return life.withColumn("part", part).where(F.col("part").isNotNull())


def replicate_variation(
    df: DataFrame, keys: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """Spread relative to the mean among replicates of the same segment, summarised per feature."""
    cells = per_feature(df, keys, features, {"n": F.count, "mean": F.avg, "std": F.stddev})
    cv = F.col("std") / F.abs("mean")
    return (
        cells.where((F.col("n") > 1) & (F.col("mean") != 0))
        .withColumn("cv", cv)
        .groupBy("feature")
        .agg(
            F.avg("cv").alias("mean_cv"),
            F.stddev("cv").alias("std_cv"),
            F.max("cv").alias("max_cv"),
            F.min("cv").alias("min_cv"),
            F.count(F.lit(1)).alias("segments_analyzed"),
        )
    )
