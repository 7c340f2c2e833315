"""Feature columns, per-feature aggregation and the long view."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathpulse.params import AGING_FEATURES, METADATA_COLUMNS


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not metadata."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in METADATA_COLUMNS
    ]


def aging_features(df: DataFrame) -> list[str]:
    return [c for c in AGING_FEATURES if c in df.columns]


def to_long(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], extra: dict[str, dict[str, Column]] | None = None
) -> DataFrame:
    """``(ids…, feature, value)``; needed only where the order of values matters.

    ``extra`` gives every feature further columns. Statistics of a feature that its rows need (a range, edges, the
    median of the row's group) come along as literals, so the long rows never have to be shuffled to meet them.
    """
    if not extra:
        doubles = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
        return doubles.unpivot(list(ids), list(features), "feature", "value")
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                *[column.alias(name) for name, column in extra[f].items()],
            )
            for f in features
        ]
    )
    return df.select(*ids, F.inline(rows))


def literals(table: DataFrame, columns: Sequence[str], features: Sequence[str]) -> dict[str, dict[str, Column]]:
    """``columns`` of a table with one row per feature as literals; null for a feature without a row."""
    found = {row["feature"]: row for row in table.select("feature", *columns).collect()}
    kinds = {c: table.schema[c].dataType for c in columns}

    def value(f: str, c: str) -> Column:
        return F.lit(found[f][c] if f in found else None).cast(kinds[c])

    return {f: {c: value(f, c) for c in columns} for f in features}


def group_literals(table: DataFrame, group: str, column: str, features: Sequence[str]) -> dict[str, Column]:
    """A column of a table ``(feature, group, column)``, with a row per feature and class, as a lookup by class.

    Classes are few; whoever has more than a plan should hold joins instead.
    """
    kind = T.MapType(table.schema[group].dataType, table.schema[column].dataType)
    maps: dict[str, dict] = {f: {} for f in features}
    for row in table.select("feature", group, column).collect():
        if row[group] is not None:
            maps[row["feature"]][row[group]] = row[column]

    def lookup(pairs: dict) -> Column:
        if not pairs:
            return F.lit(None).cast(kind.valueType)
        made = F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(v) for v in pairs.values()]))
        return F.try_element_at(made.cast(kind), F.col(group))

    return {f: lookup(pairs) for f, pairs in maps.items()}


def per_feature(
    df: DataFrame,
    by: Sequence[str],
    features: Sequence[str],
    aggregates: dict[str, Callable[[Column], Column]],
    value: Callable[[str], Column] = F.col,
) -> DataFrame:
    """The same aggregates for every feature: one row per (by, feature).

    All columns are aggregated side by side in one pass and only the finished groups are turned
    into rows, so the input is never multiplied by the number of features. ``value`` makes the aggregated column
    of a feature, itself by default.
    """
    wide = df.groupBy(*by).agg(
        *[
            fn(value(f)).alias(f"{f}|{name}")
            for f in features
            for name, fn in aggregates.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                *[F.col(f"`{f}|{name}`").alias(name) for name in aggregates],
            )
            for f in features
        ]
    )
    return wide.select(*by, F.inline(rows))


def varying_features(df: DataFrame, features: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """``(feature, n_values_differ, std, varies)``; constant and nearly constant features do not vary."""
    stats = per_feature(
        df, [], features, {"low": F.min, "high": F.max, "std": F.stddev}
    )
    differ = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    return stats.select(
        "feature",
        "std",
        (differ & F.coalesce(F.col("std") > tolerance, F.lit(False))).alias("varies"),
    )


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with missing values and how many."""
    return per_feature(
        df, [], columns, {"n_missing": lambda c: F.count_if(c.isNull())}
    ).where("n_missing > 0")
