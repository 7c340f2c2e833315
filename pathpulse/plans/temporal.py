"""The age-trend analysis of a feature table as one set of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.operators import labels, trends
from pathpulse.operators.longview import feature_columns
from pathpulse.session import cut_lineage
from pathpulse.sources.stores import write_analyses, write_table


def temporal_analysis(
    segments: DataFrame, features: Sequence[str] | None = None, conditions: Sequence[int] = (0, 1)
) -> dict[str, DataFrame]:
    """Named result tables; the binned means are found once and every trend is fitted on them."""
    features = list(features or feature_columns(segments))
    life = cut_lineage(trends.with_life_bins(segments))
    overall = cut_lineage(trends.bin_means(life, features, "lifespan_bin"))
    by_condition = cut_lineage(trends.bin_means(life, features, "lifespan_bin", ["label"]))
    end = cut_lineage(trends.bin_means(life, features, "eol_bin"))
    fits = trends.linear_trends(overall, trends.centre)
    significant = fits.where("p_value < 0.05")
    half = F.when(F.col("lifespan_percentage") <= 50, "first").when(
        F.col("lifespan_percentage") > 50, "last"
    )
    return {
        "overall": trends.linear_trends(overall),
        "per_condition": trends.linear_trends(by_condition, by=["label"]),
        "condition_means": by_condition,
        "trend_scores": trends.trend_scores(by_condition, conditions),
        "increasing": significant.where("slope > 0"),
        "decreasing": significant.where("slope <= 0"),
        "early_late": trends.part_changes(
            trends.early_and_late(life), features, "part", "early", "late"
        ),
        "first_last_50": trends.part_changes(
            life.withColumn("part", half), features, "part", "first", "last"
        ),
        "end_of_life": trends.linear_trends(end, trends.end_of_life_centre, min_bins=2),
        "end_of_life_means": end.groupBy("feature").pivot("bin", [1, 2, 3, 4]).agg(F.first("mean")),
        "replicates": trends.replicate_variation(life, ["entity", "seg"], features),
    }


def summary(results: dict[str, DataFrame]) -> DataFrame:
    """How many features are significant in each analysis that tests them."""
    parts = [
        table.agg(F.lit(name).alias("analysis"), F.count_if(F.col("p_value") < 0.05).alias("significant"))
        for name, table in results.items()
        if "p_value" in table.columns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def temporal_job(
    segments: DataFrame, path: str, features: Sequence[str] | None = None, conditions: Sequence[int] = (0, 1)
) -> DataFrame:
    """Write every table of the analysis, a folder each, and the summary; return the summary."""
    spark = segments.sparkSession
    results = temporal_analysis(segments, features, conditions)
    write_analyses(results, f"{path}/analyses")
    stored = {name: spark.read.parquet(f"{path}/analyses/analysis={name}") for name in results}
    write_table(summary(stored), f"{path}/summary")
    return spark.read.parquet(f"{path}/summary")
