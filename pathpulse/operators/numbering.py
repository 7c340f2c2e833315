"""Positions inside groups of any size.

A plain ``row_number`` over a group puts the whole group into one task. Here a group is cut into
consecutive order blocks: sizes are counted per (group, block), turned into offsets on that small
table, and rows are numbered inside their block only. A group that holds a third of all rows is
therefore spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GROUP_ROWS = 1_000_000
SEGMENTS_PER_BLOCK = 65_536


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group; one partially aggregated pass."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return row[0] or 0


def order_block(
    df: DataFrame, keys: Sequence[str], order: Column, max_rows: int = MAX_GROUP_ROWS
) -> Column | None:
    """Blocks of equal width over the integer ``order``, narrow enough for ``max_rows`` per group.

    ``None`` when every group fits as it is. The width is checked against the data and narrowed
    until the biggest (group, block) fits; only single numbers come back to the driver.
    """
    sized = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")
    )
    biggest, low, high = sized.agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    if not biggest or biggest <= max_rows:
        return None
    width = high - low + 1
    while biggest > max_rows and width > 1:
        width = max(1, width * max_rows // (2 * biggest))
        block = F.floor((order - F.lit(low)) / F.lit(width))
        biggest = largest_group(df.withColumn("_block", block), [*keys, "_block"])
    return F.floor((order - F.lit(low)) / F.lit(width))


def seg_block(column: str = "seg", size: int = SEGMENTS_PER_BLOCK) -> Column:
    """Block of a segment number; a segment number is unique in its entity, so blocks are bounded."""
    return F.floor(F.col(column) / F.lit(size))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Column | None,
    pos: str = "pos",
    total: str | None = None,
    extra: dict[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """Add the 1-based position ``pos`` of each row in its group, and the group size ``total``.

    ``block`` must not decrease along ``order``; ``None`` means the groups are known to be small.
    ``extra`` attaches whole-group extremes, ``{name: (column, "min" | "max")}``, on the same pass.
    """
    extra = extra or {}
    fold = {"min": F.min, "max": F.max}
    if block is None:
        group = Window.partitionBy(*keys)
        out = df.withColumn(pos, F.row_number().over(group.orderBy(*order)).cast("long"))
        if total:
            out = out.withColumn(total, F.count(F.lit(1)).over(group))
        for name, (column, how) in extra.items():
            out = out.withColumn(name, fold[how](column).over(group))
        return out

    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_size"),
        *[fold[how](column).alias(f"_{name}") for name, (column, how) in extra.items()],
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_size").over(whole).alias(total)] if total else []),
        *[fold[how](f"_{name}").over(whole).alias(name) for name, (_, how) in extra.items()],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(pos, F.col("_offset") + F.row_number().over(inside))
        .drop("_block", "_offset")
    )


def group_extremes(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row by aggregate-then-join.

    A window would gather the group in one task; the aggregate is combined before its shuffle and
    the join is left to adaptive execution, which splits a hot key.
    """
    per_group = df.groupBy(*keys).agg(*[column.alias(name) for name, column in aggs.items()])
    return df.join(per_group, list(keys))
