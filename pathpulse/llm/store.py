"""Intermediate tables in the shared checkpoint folder, and blocks of bounded groups."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathpulse.session import ensure_checkpoint_dir


#: Paths of the tables made in each open scope, innermost last.
_scopes: list[list[str]] = []


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again.

    The table survives a lost executor and is small on disk. Inside ``settled`` it goes when that ends; else it is
    the cluster's to clean.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, stored, without the tables that it kept on its way; also if it fails.

    The driver's garbage is collected too, upon which Spark removes the shuffle files of the finished jobs.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        out = build()
        schema = out.schema
        path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
        out.write.parquet(path)
    finally:
        _scopes.pop()  # scopes nest, so this is the one opened above
        _remove(spark, made)
    if _scopes:
        _scopes[-1].append(path)
    del out
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the table behind ``df``, which ``keep`` returned and nothing reads any more."""
    _remove(df.sparkSession, sorted({file.rpartition("/")[0] for file in df.inputFiles()}))


def _remove(spark: SparkSession, paths: list[str]) -> None:
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = files.Path(path)
        place.getFileSystem(conf).delete(place, True)


def key_hash(column: str) -> Column:
    """crc32 of the key as text; NULL for a null key."""
    return F.crc32(F.col(column).cast("string"))


def held_out(column: str, modulus: int, remainder: int = 0) -> Column:
    """True where crc32(key as text) leaves ``remainder``; a row without key is held out."""
    return F.coalesce(key_hash(column) % modulus == remainder, F.lit(True))


def in_blocks(members: DataFrame, group: list[str], item: str, limit: int) -> DataFrame:
    """Copies of ``members`` so that every pair of a group meets in a unit of bounded size.

    A group of k rows is dealt into ceil(k / limit) blocks by a hash of ``item``; the unit (left, right)
    holds the rows of both blocks. Rows of groups of one go. Adds ``block``, ``left`` and ``right``.
    """
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1")
    blocks = F.ceil(F.col("group_rows") / limit)
    return (
        members.join(sizes, group)
        .withColumn("block", F.pmod(F.xxhash64(item), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .drop("group_rows", "other")
    )


def _smaller(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v smaller, with every u and its other neighbours tied to u's smallest neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    pairs = F.array(F.struct("u", "m"), F.when(F.col("v") != F.col("m"), F.struct(F.col("v").alias("u"), "m")))
    return joined.select(F.explode(F.array_compact(pairs)).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, root): root is the smallest node reached.

    Alternates large-star and small-star steps until no edge changes. An edge list without rows gives
    no rows; self-loops and repeated edges do no harm.
    """
    down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    # one small step first: a node that many forests gave a parent keeps the smallest, and so do these parents
    stars = keep(_smaller(edges.where("a <> b").select(*down).distinct()))
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = keep(_smaller(large))
        state = stars.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("v")
        ).first()
        if state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
