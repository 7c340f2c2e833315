"""Binning of feature values and counts by bin and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathpulse.operators.features_native import with_histogram_bin
from pathpulse.operators.longview import literals, per_feature, to_long
from pathpulse.operators.ordered import exact_quantiles


def with_equal_width_bin(df: DataFrame, bins: int) -> DataFrame:
    """Add the 1-based right-closed bin of ``value`` between ``low`` and ``high``.

    The smallest value belongs to the first bin; a constant column falls in the middle one.
    """
    value, guess, width = F.col("value"), F.col("_guess"), F.col("_width")
    staged = df.withColumn("_width", (F.col("high") - F.col("low")) / bins).withColumn(
        "_guess",
        F.least(
            F.greatest(
                F.ceil(F.try_divide(value - F.col("low"), width)), F.lit(1)
            ),
            F.lit(bins),
        ),
    )
    staged = staged.withColumn(
        "_guess",
        guess
        - ((guess > 1) & (value <= F.col("low") + (guess - 1) * width)).cast("long"),
    ).withColumn(
        "_guess",
        guess + ((guess < bins) & (value > F.col("low") + guess * width)).cast("long"),
    )
    return staged.withColumn(
        "bin",
        F.when(F.col("high") > F.col("low"), guess).otherwise(F.lit((bins + 1) // 2)).cast("int"),
    ).drop("_guess", "_width")


def long_with_range(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """The long view with each feature's smallest and largest value beside its values."""
    ranges = per_feature(df, [], features, {"low": lambda c: F.min(c.cast("double")), "high": lambda c: F.max(c.cast("double"))})
    extra = literals(ranges, ["low", "high"], features)
    return to_long(df, [label], features, extra).where(F.col("value").isNotNull())


def equal_width_counts(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 5
) -> DataFrame:
    return _counts(with_equal_width_bin(long_with_range(df, label, features), bins), label)


def equal_frequency_edges(long: DataFrame, bins: int = 5) -> DataFrame:
    """Distinct exact quantile edges per feature."""
    probs = [i / bins for i in range(bins + 1)]
    return exact_quantiles(long, ["feature"], "value", probs, out="edges").withColumn(
        "edges", F.array_distinct("edges")
    )


def equal_frequency_counts(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 5
) -> DataFrame:
    """Counts per quantile bin and label; ties share a bin because repeated edges are merged."""
    long = to_long(df, [label], features).where(F.col("value").isNotNull())
    extra = literals(equal_frequency_edges(long, bins), ["edges"], features)
    beside = to_long(df, [label], features, extra).where(F.col("value").isNotNull())
    binned = beside.withColumn(
        "bin",
        F.greatest(
            F.size(F.filter("edges", lambda e: e < F.col("value"))), F.lit(1)
        ).cast("int"),
    )
    return _counts(binned, label)


def _counts(binned: DataFrame, label: str) -> DataFrame:
    return binned.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("n"))


def row_proportions(counts: DataFrame, label: str) -> DataFrame:
    """Share of each label within its bin."""
    row = Window.partitionBy("feature", "bin")
    return counts.select(
        "feature", "bin", label, "n", (F.col("n") / F.sum("n").over(row)).alias("proportion")
    )


def histogram_by_label(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 20
) -> DataFrame:
    long = long_with_range(df, label, features)
    binned = with_histogram_bin(long, "value", F.col("low"), F.col("high"), bins)
    return _counts(binned.withColumn("bin", F.col("bin").cast("int")), label)
