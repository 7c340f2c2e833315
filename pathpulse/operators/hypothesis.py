"""Group comparisons per feature: effect sizes, t, F, rank and correlation tests.

Moments come from one wide aggregation; rank tests from value counts. Only finished per-feature
statistics reach the p-value functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.functions.pvalues import f_p_value, rank_sum_p_value, t_p_value, z_p_value
from pathpulse.operators.longview import group_literals, per_feature, to_long
from pathpulse.operators.ordered import average_rank, exact_quantiles, ordered_counts

MOMENTS = {"n": F.count, "mean": F.avg, "var": F.var_samp}


def group_moments(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """``(group, feature, n, mean, var)``, missing values skipped."""
    return per_feature(df, [group], features, MOMENTS)


def two_groups(moments: DataFrame, group: str, first, second) -> DataFrame:
    """One row per feature with ``n1 mean1 var1 n2 mean2 var2``."""
    sides = [
        F.max(F.when(F.col(group) == value, F.col(name))).alias(f"{name}{i}")
        for i, value in ((1, first), (2, second))
        for name in MOMENTS
    ]
    return moments.groupBy("feature").agg(*sides)


def pooled_variance() -> Column:
    n1, n2 = F.col("n1"), F.col("n2")
    return F.try_divide((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2"), n1 + n2 - 2)


def cohens_d() -> Column:
    """Signed effect size, 0 where the pooled spread is 0."""
    return F.coalesce(
        F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled_variance())), F.lit(0.0)
    )


def effect_class(d: Column) -> Column:
    size = F.abs(d)
    return (
        F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium")
        .otherwise("large")
    )


def welch_t() -> tuple[Column, Column]:
    """Statistic and degrees of freedom for unequal variances."""
    a, b = F.try_divide(F.col("var1"), F.col("n1")), F.try_divide(F.col("var2"), F.col("n2"))
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b))
    df = F.try_divide(
        (a + b) * (a + b),
        F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1),
    )
    return t, df


def pooled_t() -> tuple[Column, Column]:
    n1, n2 = F.col("n1"), F.col("n2")
    spread = F.sqrt(pooled_variance() * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    t = F.when((n1 > 0) & (n2 > 0), F.try_divide(F.col("mean1") - F.col("mean2"), spread))
    return t, (n1 + n2 - 2).cast("double")


def effect_sizes(df: DataFrame, features: Sequence[str], group: str, first, second) -> DataFrame:
    """Absolute, relative and pooled-spread differences between two groups, largest effect first."""
    pair = two_groups(group_moments(df, features, group), group, first, second)
    whole = per_feature(df, [], features, {"mean": F.avg})
    gap = F.abs(F.col("mean1") - F.col("mean2"))
    return (
        pair.join(whole, "feature")
        .select(
            "feature",
            gap.alias("absolute_difference"),
            F.coalesce(F.try_divide(gap, F.col("mean")), F.lit(0.0)).alias("relative_difference"),
            F.abs(cohens_d()).alias("cohens_d"),
        )
        .orderBy(F.desc("cohens_d"), "feature")
    )


def anova(moments: DataFrame) -> DataFrame:
    """One-way F test over all groups, from group moments."""
    centre = F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    with_grand = moments.where(F.col("n") > 0).join(
        moments.groupBy("feature").agg(centre.alias("grand")), "feature"
    )
    parts = with_grand.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand")))
        .alias("between"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"),
        (F.count(F.lit(1)) - 1).cast("double").alias("df1"),
        (F.sum("n") - F.count(F.lit(1))).cast("double").alias("df2"),
    )
    ratio = F.try_divide(
        F.try_divide(F.col("between"), F.col("df1")), F.try_divide(F.col("within"), F.col("df2"))
    )
    return parts.select("feature", "df1", "df2", ratio.alias("f")).withColumn(
        "p_value", f_p_value("f", "df1", "df2")
    )


#: Up to so many values on one side, and without ties, the U test is exact.
EXACT_SIZE = 8


def mann_whitney(
    df: DataFrame, features: Sequence[str], group: str, first, second
) -> DataFrame:
    """Two-sided U test.

    ``method`` is ``exact`` where no value repeats and a group has at most ``EXACT_SIZE``; else ``normal``: average
    ranks, tie-corrected approximation, continuity 0.5. A feature without values in one group has no p-value.
    """
    long = to_long(df.where(F.col(group).isin(first, second)), [group], features)
    counts = ordered_counts(
        long,
        ["feature"],
        "value",
        {"n": F.count(F.lit(1)), "a": F.count_if(F.col(group) == first)},
    )
    t = F.col("n").cast("double")
    ranks = counts.groupBy("feature").agg(
        F.sum(F.col("a") * average_rank()).alias("rank_sum"),
        F.max("a_total").cast("double").alias("n1"),
        (F.max("n_total") - F.max("a_total")).cast("double").alias("n2"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    larger = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    few = (F.least(n1, n2) <= EXACT_SIZE) & (F.col("ties") == 0)
    return (
        ranks.withColumn("u", u)
        .withColumn("z", F.try_divide(larger - n1 * n2 / 2 - 0.5, spread))
        .withColumn("method", F.when(few, "exact").otherwise("normal"))
        # a row per feature; the functions skip rows that are null for them
        .withColumn("_exact", rank_sum_p_value(F.when(few, n1), n2, "u"))
        .withColumn("_normal", F.least(z_p_value("z"), F.lit(1.0)))
        .withColumn("p_value", F.when(F.least(n1, n2) > 0, F.when(few, F.col("_exact")).otherwise(F.col("_normal"))))
        .select("feature", "n1", "n2", "u", "z", "p_value", "method")
    )


def levene(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Equality of spread: one-way F test on distances to each group's exact median."""
    long = to_long(df, [group], features).where(F.col("value").isNotNull())
    medians = exact_quantiles(long, ["feature", group], "value", [0.5])
    of = group_literals(medians.select("feature", group, F.get("q", 0).alias("m")), group, "m", features)
    return anova(per_feature(df, [group], features, MOMENTS, lambda f: F.abs(F.col(f).cast("double") - of[f])))


def pearson(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Correlation with a numeric label and its t test (point-biserial when the label is 0/1)."""
    rows = per_feature(
        df,
        [],
        features,
        {
            "n": lambda c: F.count(F.when(F.col(label).isNotNull(), c)),
            "r": lambda c: F.corr(c, F.col(label).cast("double")),
        },
    )
    df_ = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(df_, 1 - F.col("r") * F.col("r")))
    return (
        rows.withColumn("t", t)
        .withColumn("p_value", t_p_value("t", df_))
        .select("feature", "n", "r", F.abs("r").alias("abs_r"), "t", "p_value")
    )


#: Up to so many different labels travel with the plan; more are joined.
LABELS_IN_PLAN = 1000


def spearman(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rank correlation with a label: Pearson over average ranks, from value counts on both sides."""
    known = df.where(F.col(label).isNotNull())
    long = to_long(known, [label], features).where(F.col("value").isNotNull())
    label_ranks = ordered_counts(long, ["feature"], label, {"n": F.count(F.lit(1))}).select(
        "feature",
        label,
        (average_rank() - (F.col("n_total") + 1) / 2).alias("label_rank"),
    )
    if known.select(label).distinct().limit(LABELS_IN_PLAN + 1).count() <= LABELS_IN_PLAN:
        of = group_literals(label_ranks, label, "label_rank", features)
        ranked = to_long(known, [], features, {f: {"label_rank": of[f]} for f in features})
        ranked = ranked.where(F.col("value").isNotNull())
    else:
        ranked = long.join(label_ranks, ["feature", label])
    # label ranks are centred, so their sums per value are all that the products need
    counts = ordered_counts(
        ranked,
        ["feature"],
        "value",
        {
            "n": F.count(F.lit(1)),
            "s": F.sum("label_rank"),
            "ss": F.sum(F.col("label_rank") * F.col("label_rank")),
        },
    )
    x = average_rank() - (F.col("n_total") + 1) / 2
    sums = counts.groupBy("feature").agg(
        F.sum(x * F.col("s")).alias("xy"), F.sum(x * x * F.col("n")).alias("xx"),
        F.sum("ss").alias("yy"),
    )
    return sums.select(
        "feature", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho")
    )


def correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson, rank and point-biserial correlation with the label, strongest first."""
    return (
        pearson(df, features, label)
        .join(spearman(df, features, label), "feature")
        .select("feature", "r", "abs_r", "rho", "t", "p_value")
        .orderBy(F.desc("abs_r"), "feature")
    )


def binned_mutual_information(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 5
) -> DataFrame:
    """Mutual information, in nats, of quantile bins and label."""
    from pathpulse.operators.bins import equal_frequency_counts

    cells = equal_frequency_counts(df, features, label, bins)
    rows = cells.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    columns = cells.groupBy("feature", label).agg(F.sum("n").alias("n_label"))
    totals = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return (
        cells.join(rows, ["feature", "bin"])
        .join(columns, ["feature", label])
        .join(totals, "feature")
        .groupBy("feature")
        .agg(
            F.sum(
                p * F.ln(F.col("n") * F.col("total") / (F.col("n_bin") * F.col("n_label")))
            ).alias("mutual_info")
        )
    )
