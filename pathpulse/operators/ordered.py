"""Order statistics over columns of any length: running counts, ranks and exact quantiles.

Rows are first collapsed to distinct values with counts. If a key still holds more rows than one
task should sort, the value axis is cut at sketch quantiles into blocks, and blocks that are still too large
are cut again; offsets come from the block totals and the running count is finished inside each block. Results are exact either way:
the sketch only decides where to cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathpulse.operators.numbering import MAX_GROUP_ROWS, largest_group
from pathpulse.session import cut_lineage, stored

CUTS = 1023
SKETCH_ACCURACY = 10_000
QUANTILE_ROWS = MAX_GROUP_ROWS
#: Keys whose cuts or edges are broadcast to the rows; a shuffle by few keys would gather all rows in as many tasks.
FEW_KEYS = 4096


def _small(per_key: DataFrame) -> DataFrame:
    """A stored table with a row per key, to be joined to rows: broadcast unless the keys are many."""
    return F.broadcast(per_key) if per_key.count() <= FEW_KEYS else per_key


def _value_cuts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sorted cut points per key, stored so that every reader of the cuts sees the same ones."""
    fractions = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    return cut_lineage(
        df.groupBy(*keys).agg(
            F.percentile_approx(F.col(value).cast("double"), fractions, SKETCH_ACCURACY).alias(
                "_cuts"
            )
        )
    )


def _cut_number(cuts: Column, value: Column) -> Column:
    """Number of cut points below ``value``, by halving steps over the sorted array."""
    steps = F.array(*[F.lit(1 << bit) for bit in range((CUTS + 1).bit_length() - 2, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda found, step: F.when(
            F.get(cuts, found + step - 1) < value, found + step
        ).otherwise(found),
    )


def ordered_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: dict[str, Column],
    max_rows: int | None = MAX_GROUP_ROWS,
    running: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (keys, value) with each measure, its sum over smaller values and its total.

    ``measures`` maps a name to an aggregate; the output has ``name``, ``name_before`` and
    ``name_total``, the latter two only for the ``running`` ones where given. ``max_rows=None`` says
    that every key is known to fit one task.
    """
    keys, sums_of = list(keys), list(running or measures)
    df = df.where(F.col(value).isNotNull())
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    split = max_rows is not None and largest_group(df, keys) > max_rows
    if split:
        cuts = _small(_value_cuts(df, keys, value))
    per_value = df.groupBy(*keys, value).agg(*[c.alias(name) for name, c in measures.items()])
    upto = [Window.unboundedPreceding, -1]

    if not split:
        whole = Window.partitionBy(*keys)
        before = whole.orderBy(value).rowsBetween(*upto)
        out = per_value
        for name in sums_of:
            out = out.withColumn(
                f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0))
            ).withColumn(f"{name}_total", F.sum(name).over(whole))
        return out.drop("_all")

    blocks = ["_block"]
    blocked = stored(
        per_value.join(cuts, keys)
        .withColumn("_block", _cut_number(F.col("_cuts"), F.col(value).cast("double")))
        .drop("_cuts")
    )
    # a block of too many values is cut again, as often as it takes; values that doubles cannot tell apart stay together
    size, before_size = largest_group(blocked, [*keys, *blocks]), None
    while size > max_rows and size != before_size:
        name = f"_block{len(blocks)}"
        finer = _small(_value_cuts(blocked, [*keys, *blocks], value))
        blocked = stored(
            blocked.join(finer, [*keys, *blocks])
            .withColumn(name, _cut_number(F.col("_cuts"), F.col(value).cast("double")))
            .drop("_cuts")
        )
        blocks.append(name)
        size, before_size = largest_group(blocked, [*keys, *blocks]), size
    sums = blocked.groupBy(*keys, *blocks).agg(*[F.sum(m).alias(f"_{m}") for m in sums_of])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(*blocks).rowsBetween(*upto)
    offsets = sums.select(
        *keys,
        *blocks,
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}_off") for m in sums_of],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_total") for m in sums_of],
    )
    inside = Window.partitionBy(*keys, *blocks).orderBy(value).rowsBetween(*upto)
    out = blocked.join(offsets, [*keys, *blocks])
    for m in sums_of:
        out = out.withColumn(
            f"{m}_before", F.col(f"_{m}_off") + F.coalesce(F.sum(m).over(inside), F.lit(0))
        )
    return out.drop("_all", *blocks, *[f"_{m}_off" for m in sums_of])


def average_rank(count: str = "n") -> Column:
    """Mean rank shared by the tied rows of one value, from ``ordered_counts`` columns."""
    return F.col(f"{count}_before") + (F.col(count) + 1) / 2


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    max_rows: int = QUANTILE_ROWS,
    out: str = "q",
) -> DataFrame:
    """Linear-interpolated quantiles per key as an array column.

    Groups that fit one task use the built-in aggregate. For larger ones a sketch brackets each
    quantile, one pass counts the rows between brackets, and only the rows inside are ordered, so
    the values themselves are never shuffled. Should a bracket miss its ranks, all values of the
    large groups are ordered instead.
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    df = df.where(F.col(value).isNotNull())
    if largest_group(df, keys) <= max_rows:
        return _built_in(df, keys, value, probs, out)
    large = df
    if keys:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        big = _small(cut_lineage(sizes.where(F.col("_n") > max_rows).select(*keys)))
        large = df.join(big, keys, "left_semi")
    found = cut_lineage(_from_counts(_lumped_counts(large, keys, value, probs), keys, probs))
    if found.where("missed").count():
        exact = ordered_counts(large, keys, value, {"n": F.count(F.lit(1))})
        exact = exact.withColumn("lump", F.lit(False)).withColumnRenamed(value, "v")
        found = _from_counts(exact, keys, probs)
    found = found.select(*keys, F.col("q").alias(out))
    if not keys:
        return found
    rest = df.join(big, keys, "left_anti")
    return found.unionByName(_built_in(rest, keys, value, probs, out))


def _built_in(
    df: DataFrame, keys: list[str], value: str, probs: list[float], out: str
) -> DataFrame:
    per_value = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy(*keys).agg(F.percentile(value, probs, F.col("_n")).alias(out))


def _lumped_counts(
    df: DataFrame, keys: list[str], value: str, probs: list[float]
) -> DataFrame:
    """Running counts over values near the wanted quantiles and over the lumps of values in between."""
    margin = 4 / SKETCH_ACCURACY
    edges = sorted({min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)})
    names = [f"_e{i}" for i in range(len(edges))]
    # stored, so that the edges are the same however often a task reruns
    sketch = cut_lineage(
        df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_rows"),
            F.percentile_approx(F.col(value).cast("double"), edges, SKETCH_ACCURACY).alias("_e"),
        )
    ).select(*keys, "_rows", *[F.get("_e", i).alias(c) for i, c in enumerate(names)])
    biggest = sketch.agg(F.max("_rows")).first()[0]
    if keys:
        marked = df.join(_small(sketch.drop("_rows")), keys)
    else:
        only = sketch.first()
        marked = df.withColumns({c: F.lit(only[c]) for c in names})

    # the edge below each value tells its lump; values inside a bracket stand for themselves
    passed = sum(((F.col(value) >= F.col(c)).cast("int") for c in names), F.lit(0))
    near = F.lit(False)
    for p in probs:
        low = names[edges.index(max(0.0, p - margin))]
        high = names[edges.index(min(1.0, p + margin))]
        near = near | F.col(value).between(F.col(low), F.col(high))
    pieces = (
        marked.withColumn("_own", F.when(near, F.col(value)))
        .withColumn("_lump", F.when(F.col("_own").isNull(), passed))
        .groupBy(*keys, "_lump", "_own")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("v"))
        .withColumn("lump", F.col("_lump").isNotNull())
    )
    # two lumps never share a smallest value, so (v, lump) identifies a piece
    expected = biggest * 2 * margin * len(probs)
    limit = MAX_GROUP_ROWS if expected > MAX_GROUP_ROWS else None
    return ordered_counts(
        pieces, keys, "v", {"n": F.sum("_n"), "lump": F.max("lump")}, limit, running=["n"]
    )


def _from_counts(counts: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles by rank from running counts; ``missed`` where a rank lies inside a lump."""
    pick = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            own = F.when(holds & ~F.col("lump"), F.col("v").cast("double"))
            pick.append(F.max(own).alias(f"{side}{i}"))
    found = counts.groupBy(*keys).agg(F.max("n_total").alias("n_total"), *pick)
    points = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n_total") - 1)
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        points.append(low + (high - low) * (position - F.floor(position)))
    return found.select(
        *keys, F.array(*points).alias("q"), F.exists(F.array(*points), lambda q: q.isNull()).alias("missed")
    )
