"""Exact evaluation of class predictions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.operators.ordered import average_rank, ordered_counts


def outcome_counts(
    df: DataFrame, keys: Sequence[str], label: str, prediction: str, **extra: Column
) -> DataFrame:
    """``tp fp fn tn`` per key, with further aggregates on the same pass."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
        *[c.alias(name) for name, c in extra.items()],
    )


def metric_columns(*names: str) -> list[Column]:
    """Metrics from outcome counts; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    every = {
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    }
    chosen = names or tuple(every)
    return [F.coalesce(every[n], F.lit(0.0)).alias(n) for n in chosen]


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, and their plain and weighted means."""
    # each row counts once under its label and once under its prediction
    sides = df.select(
        F.explode(
            F.array(
                F.struct(F.col(label).alias("k"), F.lit(1).alias("s"), F.lit(0).alias("p")),
                F.struct(F.col(prediction).cast("int").alias("k"), F.lit(0).alias("s"), F.lit(1).alias("p")),
            )
        ).alias("e"),
        (F.col(label) == F.col(prediction)).alias("hit"),
    )
    per_class = sides.groupBy(F.col("e.k").alias("k")).agg(
        F.sum("e.s").alias("support"),
        F.sum("e.p").alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("e.s")).otherwise(0)).alias("hits"),
    )

    def share(top: Column, below: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), below.cast("double")), F.lit(0.0))

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    scored = per_class.select(
        F.col("k").cast("string").alias("class"),
        share(hits, predicted).alias("precision"),
        share(hits, support).alias("recall"),
        share(2 * hits, support + predicted).alias("f1"),
        "support",
    )
    names = ("precision", "recall", "f1")
    macro = scored.agg(
        F.lit("macro avg").alias("class"),
        *[F.avg(n).alias(n) for n in names],
        F.sum("support").alias("support"),
    )
    weighted = scored.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(n) * support) / F.sum("support")).alias(n) for n in names],
        F.sum("support").alias("support"),
    )
    return scored.unionByName(macro).unionByName(weighted)


def score_counts(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = ()
) -> DataFrame:
    return ordered_counts(
        df, keys, score, {"n": F.count(F.lit(1)), "pos": F.count_if(F.col(label) == 1)}
    )


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks, so ties count half."""
    sums = score_counts(df, score, label, keys).groupBy(*keys).agg(
        F.sum(F.col("pos") * average_rank()).alias("rank_sum"),
        F.max("pos_total").cast("double").alias("n1"),
        (F.max("n_total") - F.max("pos_total")).cast("double").alias("n0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    return sums.select(
        *keys, "n1", "n0",
        F.try_divide(F.col("rank_sum") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"),
    )


def curve_points(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Per distinct threshold: ``tp fp`` at or above it with the ROC and precision-recall values."""
    tp = F.col("pos_total") - F.col("pos_before")
    flagged = F.col("n_total") - F.col("n_before")
    negatives = (F.col("n_total") - F.col("pos_total")).cast("double")
    return score_counts(df, score, label, keys).select(
        *keys,
        F.col(score).alias("threshold"),
        tp.alias("tp"),
        (flagged - tp).alias("fp"),
        F.try_divide(tp.cast("double"), F.col("pos_total").cast("double")).alias("tpr"),
        F.try_divide((flagged - tp).cast("double"), negatives).alias("fpr"),
        (tp / flagged).alias("precision"),
    )


def fold_summary(scores: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of a score over folds."""
    return scores.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("folds")
    )
