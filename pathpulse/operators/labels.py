"""Position of a segment in the life of its entity, and labels built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathpulse.operators.numbering import group_extremes


def with_life_percentage(segments: DataFrame) -> DataFrame:
    """Add ``max_segment``, ``total_segments`` and ``lifespan_percentage``; null for a single segment 0."""
    spread = group_extremes(
        segments, ["entity"], max_segment=F.max("seg"), total_segments=F.count(F.lit(1))
    )
    share = F.try_divide(F.col("seg").cast("double"), F.col("max_segment").cast("double"))
    return spread.withColumn("lifespan_percentage", share * 100)


def close_to_death(segments: DataFrame, threshold: int = 5, inclusive: bool = False) -> DataFrame:
    """``death_close``: the last ``threshold`` segment numbers, or one more when ``inclusive``."""
    spread = group_extremes(segments, ["entity"], max_segment=F.max("seg")).withColumn(
        "segments_from_end", F.col("max_segment") - F.col("seg")
    )
    near = F.col("segments_from_end") <= threshold if inclusive else (
        F.col("segments_from_end") < threshold
    )
    return spread.withColumn("death_close", near.cast("int"))


def first_segments(
    segments: DataFrame, n: int, labeling: str = "original", threshold: int = 5
) -> DataFrame:
    """Segments numbered below ``n``; labels are made afterwards, on the kept ones."""
    return labelled(segments.where(F.col("seg") < n), labeling, threshold)


def labelled(segments: DataFrame, labeling: str, threshold: int = 5) -> DataFrame:
    if labeling == "original":
        return segments
    if labeling == "death_proximity":
        return close_to_death(segments, threshold).withColumn("label", F.col("death_close"))
    raise ValueError(f"unknown labeling strategy: {labeling}")


def halves_by_percentage(segments: DataFrame, threshold: float = 50) -> DataFrame:
    """``part``: ``first`` up to the threshold of life, else ``last``."""
    life = with_life_percentage(segments)
    return life.withColumn(
        "part",
        F.when(F.col("lifespan_percentage") <= threshold, "first").when(
            F.col("lifespan_percentage") > threshold, "last"
        ),
    ).where(F.col("part").isNotNull())


def first_and_last(segments: DataFrame, n: int) -> DataFrame:
    """The first and last ``n`` segments of entities with more than ``2 n``.

    A rank filter directly above its window is limited before the shuffle, so a long entity sends
    ``n`` rows per task and not its whole life.
    """
    enough = group_extremes(segments, ["entity"], total_segments=F.count(F.lit(1))).where(
        F.col("total_segments") > 2 * n
    )
    ends = []
    for part, order in (("first", F.col("seg")), ("last", F.col("seg").desc())):
        rank = F.row_number().over(Window.partitionBy("entity").orderBy(order))
        ends.append(
            enough.withColumn("_rank", rank)
            .where(F.col("_rank") <= n)
            .drop("_rank")
            .withColumn("part", F.lit(part))
        )
    return ends[0].unionByName(ends[1])


def entity_labels(segments: DataFrame) -> DataFrame:
    """One label per entity: that of its earliest segment."""
    return segments.groupBy("entity").agg(F.min_by("label", "seg").alias("label"))


def life_bin(percentage: Column) -> Column:
    """Fifths of life, right-closed: (0, 20] is 1, (80, 100] is 5; 0 itself lies in none."""
    return F.when((percentage > 0) & (percentage <= 100), F.ceil(percentage / 20).cast("int"))


def end_of_life_bin(percentage: Column) -> Column:
    """Quarters of the last fifth, right-closed: (80, 85] is 1; 80 itself lies in none."""
    return F.when(
        (percentage > 80) & (percentage <= 100), F.ceil((percentage - 80) / 5).cast("int")
    )


def ten_percent_bin(percentage: Column) -> Column:
    return (F.floor(percentage / 10) * 10).cast("int")
