"""Summaries of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.operators.longview import group_literals, per_feature, to_long
from pathpulse.operators.ordered import exact_quantiles
from pathpulse.session import stored


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles per feature."""
    moments = per_feature(
        df,
        [],
        features,
        {"n": F.count, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max},
    )
    quartiles = exact_quantiles(to_long(df, [], features), ["feature"], "value", [0.25, 0.5, 0.75])
    return moments.join(quartiles, "feature").select(
        "feature", "n", "mean", "std", "min",
        F.get("q", 0).alias("q25"), F.get("q", 1).alias("q50"), F.get("q", 2).alias("q75"), "max",
    )


def box_statistics(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 quartile ranges, and the outliers beyond."""
    long = to_long(df, [label], features).where(F.col("value").isNotNull())
    quartiles = stored(exact_quantiles(long, ["feature", label], "value", [0.25, 0.5, 0.75]))
    of = group_literals(quartiles, label, "q", features)

    def beyond(f: str) -> Column:
        """The value where it is an outlier of its class, with a flag."""
        low, high = F.get(of[f], 0), F.get(of[f], 2)
        v, reach = F.col(f).cast("double"), (high - low) * 1.5
        return F.struct(v.between(low - reach, high + reach).alias("inside"), v.alias("v"))

    whiskers = per_feature(
        df, [label], features,
        {
            "whisker_low": lambda c: F.min(F.when(c["inside"], c["v"])),
            "whisker_high": lambda c: F.max(F.when(c["inside"], c["v"])),
            "outliers": lambda c: F.count_if(~c["inside"]),
        },
        beyond,
    )
    # a row per feature and class on either side
    return whiskers.join(quartiles, ["feature", label]).select(
        "feature", label,
        F.get("q", 0).alias("q25"), F.get("q", 1).alias("q50"), F.get("q", 2).alias("q75"),
        "whisker_low", "whisker_high", "outliers",
    )


def normalized_means(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Mean per class after scaling each feature to [0, 1]; a constant feature is 0.

    Scaling is linear, so the class means are scaled and the rows are read once.
    """
    by_class = per_feature(df, [label], features, {"mean": F.avg, "low": F.min, "high": F.max})
    whole = by_class.groupBy("feature").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    scaled = F.try_divide(F.col("mean") - F.col("lo"), F.col("hi") - F.col("lo"))
    return by_class.join(whole, "feature").select(
        "feature", label, F.coalesce(scaled, F.lit(0.0)).alias("mean")
    )


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Lower triangle of pairwise Pearson correlations, missing values skipped per pair; one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[:i]]
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"c{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.inline(rows))


def data_info(segments: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Rows, feature count, entities, class counts and sequence lengths in one row."""
    from pathpulse.operators.longview import feature_columns

    per_entity = segments.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 0).alias("n0"),
        F.count_if(F.col("label") == 1).alias("n1"),
    )
    info = per_entity.agg(
        F.sum("n").alias("samples"),
        F.lit(len(feature_columns(segments))).cast("long").alias("features"),
        F.count(F.lit(1)).alias("entities"),
        F.sum("n0").alias("class_0"),
        F.sum("n1").alias("class_1"),
    )
    if lengths is None:
        return info
    sizes = lengths.agg(
        F.min("n_frames").alias("min_length"),
        F.max("n_frames").alias("max_length"),
        F.avg("n_frames").alias("mean_length"),
    )
    return info.withColumn("_one", F.lit(1)).join(sizes.withColumn("_one", F.lit(1)), "_one").drop("_one")


def random_sample(df: DataFrame, keys: Sequence[str], n: int = 500, seed: int = 42) -> DataFrame:
    """At most ``n`` rows picked by a hash of their key; the same rows every time."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.orderBy(digest, *keys).limit(n)
