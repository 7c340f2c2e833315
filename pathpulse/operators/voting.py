"""Segment predictions to entity and group decisions by weighted vote.

Input: ``fold, entity, seg, label, p0, p1, prediction``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathpulse.operators.numbering import MAX_GROUP_ROWS, number_rows, seg_block

STRATEGIES = (
    "uniform",
    "confidence",
    "late_segments",
    "early_segments",
    "last_2_segments",
    "last_2_segments_confidence",
    "late_segments_confidence",
)


def with_segment_positions(predictions: DataFrame) -> DataFrame:
    """Add the 1-based place ``pos`` of a segment in its entity and the entity's size ``n``."""
    return number_rows(predictions, ["fold", "entity"], ["seg"], seg_block(), "pos", total="n")


def segment_weight(strategy: str) -> Column:
    """Weight of a segment under a named strategy; an unknown name weighs all alike.

    ``last_0`` keeps every segment, as an empty tail cut does.
    """
    pos, n = F.col("pos"), F.col("n")
    confidence = F.greatest("p0", "p1")
    share = F.coalesce(F.try_divide((pos - 1).cast("double"), (n - 1).cast("double")), F.lit(0.0))
    tail = re.fullmatch(r"last_(\d+)_segments(_confidence)?", strategy)
    if tail:
        kept = int(tail.group(1))
        base = confidence if tail.group(2) else F.lit(1.0)
        return base if kept == 0 else F.when(pos > n - kept, base).otherwise(F.lit(0.0))
    return {
        "confidence": confidence,
        "late_segments": share + 0.5,
        "early_segments": F.lit(1.5) - share,
        "late_segments_confidence": (share + 0.5) * confidence,
    }.get(strategy, F.lit(1.0))


def decide(
    rows: DataFrame, keys: Sequence[str], prediction: str, weight: str, **extra: Column
) -> DataFrame:
    """Weighted vote per key: class 1 only if strictly heavier; confidence is the winner's share.

    Weights are summed in no fixed order, so sums are compared after rounding off the last bits:
    a tie stays a tie. ``extra`` adds aggregates on the same pass.
    """
    votes = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col(prediction) == 0, F.col(weight)).otherwise(0.0)).alias("w0"),
        F.sum(F.when(F.col(prediction) == 1, F.col(weight)).otherwise(0.0)).alias("w1"),
        F.count(F.lit(1)).alias("n_votes"),
        F.avg(weight).alias("avg_weight"),
        F.stddev_pop(weight).alias("weight_std"),
        *[c.alias(name) for name, c in extra.items()],
    )
    total = F.col("w0") + F.col("w1")
    return votes.withColumns(
        {
            "predicted": (F.round("w1", 9) > F.round("w0", 9)).cast("int"),
            "confidence": F.when(total > 0, F.greatest("w0", "w1") / total).otherwise(0.5),
        }
    ).drop("w0", "w1")


def entity_votes(predictions: DataFrame, strategy: str) -> DataFrame:
    """One decision per fold and entity."""
    weighted = with_segment_positions(predictions).withColumn("weight", segment_weight(strategy))
    return decide(weighted, ["fold", "entity", "label"], "prediction", "weight").withColumn(
        "correct", F.col("predicted") == F.col("label")
    )


def strategy_votes(predictions: DataFrame, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """Decisions under several strategies from one set of predictions."""
    choices = F.array(
        *[F.struct(F.lit(s).alias("strategy"), segment_weight(s).alias("weight")) for s in strategies]
    )
    weighted = with_segment_positions(predictions).select(
        "fold", "entity", "label", "prediction", F.inline(choices)
    )
    return decide(
        weighted, ["strategy", "fold", "entity", "label"], "prediction", "weight"
    ).withColumn("correct", F.col("predicted") == F.col("label"))


def compare_strategies(
    predictions: DataFrame, strategies: Sequence[str] = STRATEGIES
) -> DataFrame:
    """Accuracy, F1 and mean confidence per strategy, most accurate first."""
    from pathpulse.operators.evaluation import metric_columns, outcome_counts

    votes = strategy_votes(predictions, strategies)
    counted = outcome_counts(
        votes, ["strategy"], "label", "predicted", avg_confidence=F.avg("confidence")
    )
    return (
        counted.select("strategy", *metric_columns("accuracy", "f1"), "avg_confidence")
        .orderBy(F.desc("accuracy"), "strategy")
    )


def entity_block(
    df: DataFrame, keys: Sequence[str] = ("fold", "label"), size: int = 65_536, prefix: int = 33, most: int = MAX_GROUP_ROWS
) -> Column:
    """Order block for entities: id ranges, or the leading part of names.

    The leading part begins with the date and grows until no block of a group holds more than ``most`` rows.
    """
    if isinstance(df.schema["entity"].dataType, T.NumericType):
        return F.floor(F.col("entity") / F.lit(size))
    longest = df.agg(F.max(F.length("entity"))).first()[0] or 0
    lengths = [*range(prefix, max(longest, prefix), 4), max(longest, prefix)]
    # the largest block for every length at once
    leads = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("entity", 1, n).alias("lead")) for n in lengths]))
    blocks = df.select(*keys, leads.alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("rows"))
    largest = dict(blocks.groupBy("x.n").agg(F.max("rows")).collect())
    fits = [n for n in lengths if largest.get(n, 0) <= most]
    return F.substring("entity", 1, fits[0] if fits else lengths[-1])


def group_votes(
    predictions: DataFrame, strategy: str = "confidence", group_size: int = 5
) -> DataFrame:
    """Complete groups of ``group_size`` entities of one fold and class vote with their confidence."""
    decided = entity_votes(predictions, strategy)
    placed = number_rows(
        decided, ["fold", "label"], ["entity"], entity_block(decided), "place"
    ).withColumn("chunk", F.floor((F.col("place") - 1) / F.lit(group_size)))
    keys = ["fold", "label", "chunk"]
    members = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "predicted"))), lambda m: m["predicted"]
    )
    return (
        decide(placed, keys, "predicted", "confidence", individual_preds=members)
        .where(F.col("n_votes") == group_size)
        .select(
            *keys,
            F.col("predicted").alias("predicted_class"),
            F.col("confidence").alias("group_confidence"),
            "individual_preds",
        )
    )


def group_vote_summary(groups: DataFrame) -> DataFrame:
    """Accuracy over all groups and per class, and the mean confidence."""
    right = (F.col("predicted_class") == F.col("label")).cast("double")
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("label") == 0, right)), F.lit(0.0)).alias("control_accuracy"),
        F.coalesce(F.avg(F.when(F.col("label") == 1, right)), F.lit(0.0)).alias(
            "treatment_accuracy"
        ),
        F.avg("group_confidence").alias("avg_confidence"),
    )
