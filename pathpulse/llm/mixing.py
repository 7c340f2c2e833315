"""Mixing sources to target weights by histograms over hash thresholds, in DataFrame operations throughout.

A source's target says how often its documents are taken: each whole time round all of them, and once more
those whose hash lies below the source's threshold. The threshold is found without sorting: sizes are summed by
source and hash bucket, the first bucket whose running sum reaches the budget is refined by the next digits of the
hash, and so on until every boundary bucket holds one document. A larger target only moves a threshold up, so mixes
to growing targets are nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathpulse.llm.store import keep
from pathpulse.operators.numbering import number_rows

WORD = r"[^\x20\x09-\x0D]+"
#: A hash has six digits of ten bits; a document's place has six more, for rows of equal id and text.
DIGIT_BITS = 10
DIGITS = 6


@dataclass(frozen=True)
class Mixture:
    """Sources in order of their names (null last) weigh ``weights``, repeating; they share ``share`` times all
    sizes, and none gets more than ``most`` times its own size."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2

    def __post_init__(self):
        if not self.weights or min(self.weights) <= 0 or not 0 < self.share <= self.most:
            raise ValueError("weights above 0 and 0 < share <= most are needed")


def _digits(column: str) -> list[Column]:
    """The digits of a 60-bit number, highest first."""
    steps = range(DIGIT_BITS * (DIGITS - 1), -1, -DIGIT_BITS)
    return [F.shiftright(column, k).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int") for k in steps]


def text_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of id and text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, text)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, p: Mixture = Mixture()) -> DataFrame:
    """``sizes`` (source, source_size) with the weight and target of every source.

    A source above its most is held there, and what it leaves is dealt to the others by weight, until none is
    above; each round is an aggregate over the source table.
    """
    names = sizes.select("source", "source_size", F.expr("CASE WHEN source IS NULL THEN 1 ELSE 0 END").alias("last"))
    # names are dealt to blocks by their first two bytes, so however many there are, no task holds them all
    block = F.when(F.col("last") == 1, 1 << 20).otherwise(
        F.coalesce(F.conv(F.substring(F.rpad(F.hex(F.encode("source", "utf-8")), 4, "0"), 1, 4), 16, 10).cast("int"), F.lit(0))
    )
    ranked = number_rows(names.withColumn("all", F.lit(1)), ["all"], ["last", "source"], block, pos="rank")
    cycle = F.array(*[F.lit(w).cast("long") for w in p.weights])
    weighed = keep(ranked.select("source", "source_size", F.get(cycle, ((F.col("rank") - 1) % len(p.weights)).cast("int")).alias("weight")))
    most = F.col("source_size") * p.most
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * p.share
    level = 0.0
    while True:
        held = most <= F.col("weight") * F.lit(level)
        taken, weight = weighed.agg(F.sum(F.when(held, most)), F.sum(F.when(~held, F.col("weight")))).first()
        if weight is None:
            break
        reached = (total - (taken or 0)) / weight
        if reached <= level:
            break
        level = reached
    return weighed.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(level)))


def _same_source(left: str = "source") -> Column:
    return F.col(left).eqNullSafe(F.col("for"))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a budget beyond whole rounds: ``path`` (digits of the boundary document) and ``include``.

    ``below`` sums what lies under the boundary bucket. Each step reads only the rows in a boundary bucket of the
    step before, and gets at most 1,024 sums a source from each task.
    """
    budget = F.col("target") - F.col("rounds") * F.col("source_size")
    state = keep(
        targets.where(budget > 0).select(
            F.col("source").alias("for"), budget.alias("budget"), F.lit(0).cast("long").alias("below"),
            F.array().cast("array<int>").alias("path"), F.lit(2).cast("long").alias("docs"), F.lit(0).cast("long").alias("sum"),
        )
    )
    depth = 0
    while depth < 2 * DIGITS and state.where("docs > 1").limit(1).count():
        near = rows.where("size > 0").join(state.select("for", "path"), _same_source() & (F.slice("digits", 1, depth) == F.col("path")))
        sums = near.groupBy("for", F.get("digits", F.lit(depth)).alias("digit")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("docs"))
        upto = F.sum("sum").over(Window.partitionBy("for").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        old = state.select(F.col("for").alias("source"), "budget", "below", "path")
        passed = sums.withColumn("upto", upto).join(old, _same_source())
        passed = passed.where(F.col("below") + F.col("upto") >= F.col("budget"))
        first = passed.groupBy("for").agg(F.min_by(F.struct("budget", "below", "upto", "sum", "docs", "digit", "path"), "digit").alias("b"))
        state = keep(
            first.select(
                "for", "b.budget", (F.col("b.below") + F.col("b.upto") - F.col("b.sum")).alias("below"),
                F.concat("b.path", F.array("b.digit")).alias("path"), "b.docs", "b.sum",
            )
        )
        depth += 1
    # the boundary document is taken if that comes as near to the budget
    return state.select("for", "path", (2 * (F.col("budget") - F.col("below")) >= F.col("sum")).alias("include"))


def mixed(
    docs: DataFrame, p: Mixture = Mixture(), doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """``carry`` columns of ``docs`` (all, if None) with size, source_size, target, times and taken of every row.

    ``times`` says how often the mix takes the document and ``taken`` is times * size. Size counts words, which are
    runs of characters other than ASCII white space; a null or empty text has 0, a long one counts whole. A null
    source is a source of its own, the last. A source's taken words differ from its target by half a document
    at most, the one on the threshold, whose order is by hash of id and text. Rows of equal id and text, null ids
    among them, are each a document; which of them a threshold between them takes is left open. No document is
    taken more than ``p.most`` times. Columns of ``docs`` that are named like a result are replaced; an empty table
    stays empty.
    """
    made = ("size", "source_size", "target", "times", "taken")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    row = docs.select(
        F.struct(*[docs[c] for c in carry]).alias("row") if carry else F.lit(None).alias("row"),
        docs[source].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        text_hash(docs[doc_id], docs[text]).alias("hash"),
        F.monotonically_increasing_id().alias("place"),
    )
    # stored once: the numbers of rows must not change between the steps
    rows = keep(row.withColumn("tie", F.shiftrightunsigned(F.xxhash64("place"), 64 - DIGITS * DIGIT_BITS)))
    rows = rows.withColumn("digits", F.array(*_digits("hash"), *_digits("tie")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), p)
    targets = keep(targets.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)))
    limits = _thresholds(rows, targets).withColumnRenamed("for", "of")
    plan = targets.join(limits, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("for"), "source_size", "target", "rounds", "path", "include"
    )
    here = F.slice("digits", 1, F.size("path"))
    more = F.when(here == F.col("path"), F.col("include")).otherwise(here < F.col("path"))
    # the plan has a row a source; kept as a table, its true size decides whether Spark broadcasts it
    dealt = rows.join(keep(plan), _same_source()).withColumn("times", F.col("rounds").cast("long") + F.coalesce(more, F.lit(False)).cast("long"))
    return dealt.select(*[F.col("row")[c].alias(c) for c in carry], "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixture_digest(docs: DataFrame, p: Mixture = Mixture()) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mixed(docs, p, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def mixture_sql(p: Mixture = Mixture()) -> str:
    """The same result in DuckDB SQL over ``documents``, by a running sum in hash order."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(
        len(p.weights), " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(p.weights))
    )
    return f"""WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source), w AS (
  SELECT *, {weight} AS weight FROM s), levels AS (
  SELECT *, row_number() OVER o AS place,
         ({p.share} * sum(source_size) OVER () - coalesce({p.most} * sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)), reached AS (
  SELECT coalesce(arg_min(level, place), 1e300) AS level FROM levels WHERE {p.most} * source_size > weight * level), t AS (
  SELECT w.*, CAST(least({p.most} * source_size, weight * level) AS DOUBLE) AS target FROM w, reached), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t), x AS (
  SELECT d.*, source_size, target, rounds, target - rounds * source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (rounds + CASE WHEN budget <= 0 THEN 0 WHEN upto < budget THEN 1
                                  WHEN upto - size < budget AND 2 * (budget - (upto - size)) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x"""
