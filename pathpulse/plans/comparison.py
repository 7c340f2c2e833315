"""First against last part of life, from the feature table to stored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pathpulse.operators import compare
from pathpulse.operators.longview import feature_columns
from pathpulse.sources.stores import write_csv, write_table


def first_last_job(
    segments: DataFrame, path: str, features: Sequence[str] | None = None, definition: str = "percentage", threshold: int = 50
) -> DataFrame:
    """Write the statistics with their four rankings, best combined rank first, and the counts; return the rankings.

    ``results`` holds the table, ``results_csv`` the same as text in rank order and ``summary`` one line of counts.
    """
    spark = segments.sparkSession
    names = list(features or feature_columns(segments))
    write_table(compare.ranked(compare.first_against_last(segments, names, definition, threshold)), f"{path}/results")
    results = spark.read.parquet(f"{path}/results")
    # a row per feature: one file keeps their order
    write_csv(results.coalesce(1).sortWithinPartitions("rank_combined"), f"{path}/results_csv")
    write_table(compare.summary_counts(results), f"{path}/summary")
    return results
