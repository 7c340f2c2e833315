"""Entity-safe stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.operators.labels import entity_labels
from pathpulse.operators.numbering import number_rows


def entity_folds(segments: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``(entity, label, fold)``: entities of a label in hash order, dealt out in turn.

    The hash prefix is the order block, so a label with most of the entities is still numbered in
    4096 pieces.
    """
    hashed = entity_labels(segments).withColumn(
        "_hash", F.md5(F.concat_ws("|", F.col("entity").cast("string"), F.lit(str(seed))))
    )
    numbered = number_rows(
        hashed, ["label"], ["_hash", "entity"], F.substring("_hash", 1, 3), pos="_pos"
    )
    return numbered.select("entity", "label", ((F.col("_pos") - 1) % k).cast("int").alias("fold"))


def with_folds(segments: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return segments.join(entity_folds(segments, k, seed).select("entity", "fold"), "entity")
