"""Tracks read from the event log: one entity per user, one frame per event in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathpulse.operators.numbering import MAX_GROUP_ROWS, number_rows, order_block
from pathpulse.sources.tables import read_table


def event_tracks(
    spark: SparkSession, folder: str, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """``(entity, label, frame, speed, x, y)`` with gaps in x and y where the event is an error."""
    events = read_table(spark, folder, "events").select(
        F.col("user_id").alias("entity"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
        "value",
        F.when(F.col("event_type") != "error", True).alias("seen"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    block = order_block(events, ["entity"], F.col("at"), max_rows)
    numbered = number_rows(events, ["entity"], ["at", "event_id"], block, pos="frame")
    return numbered.select(
        "entity",
        (F.col("entity") % 2).cast("int").alias("label"),
        "frame",
        (F.col("value") / 20).alias("speed"),
        F.when(F.col("seen"), F.col("value")).alias("x"),
        F.when(F.col("seen"), F.lit(7.49) * F.col("k")).alias("y"),
    )


def event_lifespans(spark: SparkSession, folder: str, segment_len: int) -> DataFrame:
    """Seconds lived per entity; entities divisible by 17 are unknown to the lookup."""
    users = read_table(spark, folder, "events").select(F.col("user_id").alias("entity")).distinct()
    return users.where("entity % 17 <> 0").select(
        "entity", ((3 + F.col("entity") % 3) * segment_len + segment_len / 2).alias("seconds")
    )
