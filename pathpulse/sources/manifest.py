"""What a folder holds against what could be read of it: absent, broken and incomplete files.

Readers skip files they cannot decode. Here every file gets a line saying how much of it was read and why the rest
is missing, so that nothing is lost in silence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"


def listed_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, bytes)`` of all files below ``folder``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.col("length").alias("bytes"))
    )


def decoded(path: Column) -> Column:
    """A path as listings spell it; in a scan's metadata blanks and other signs are escaped."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def relative_path(path: Column, folder: str) -> Column:
    """What follows ``folder`` in a path, whatever scheme either is written with."""
    root = folder.rstrip("/") + "/"
    scheme, colon, rest = root.partition(":")
    bare = (rest if colon and "/" not in scheme else root).lstrip("/")
    inside = F.substring(path, F.locate(bare, path) + F.lit(len(bare)), F.length(path))
    return F.when(F.contains(path, F.lit(bare)), inside).otherwise(path)


def write_manifest(spark: SparkSession, folder: str) -> None:
    """Note name, size and rows of every Parquet file below ``folder``, beside the data."""
    rows = (
        spark.read.parquet(folder)
        .groupBy(decoded(F.col("_metadata.file_path")).alias("path"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    files = listed_files(spark, folder, "*.parquet").join(rows, "path", "left")
    files.select(
        relative_path(F.col("path"), folder).alias("file"), "bytes", F.coalesce("rows", F.lit(0)).alias("rows")
    ).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{MANIFEST}")


def read_tolerant(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """Parquet files of ``folder`` without those that cannot be decoded or went meanwhile."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return (reader.schema(schema) if schema else reader).parquet(folder)


def stored_report(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, bytes, rows, bytes_now, rows_read, status)`` of every file that was or is in a stored table.

    ``status``: ``ok``, ``missing`` (noted but gone), ``unnoted`` (there but not noted), ``unreadable`` (no
    row came out) or ``changed`` (other size or rows than noted).
    """
    noted = spark.read.parquet(f"{folder.rstrip('/')}/{MANIFEST}")
    now = listed_files(spark, folder, "*.parquet").select(
        relative_path(F.col("path"), folder).alias("file"), F.col("bytes").alias("bytes_now")
    ).where(~F.startswith("file", F.lit(f"{MANIFEST}/")))
    read = (
        read_tolerant(spark, folder)
        .groupBy(relative_path(decoded(F.col("_metadata.file_path")), folder).alias("file"))
        .agg(F.count(F.lit(1)).alias("rows_read"))
    )
    every = noted.join(now, "file", "full").join(read, "file", "left")
    rows_read = F.coalesce("rows_read", F.lit(0))
    status = (
        F.when(F.col("bytes_now").isNull(), "missing")
        .when(F.col("bytes").isNull(), "unnoted")
        .when((rows_read == 0) & (F.col("rows") > 0), "unreadable")
        .when((F.col("bytes") != F.col("bytes_now")) | (F.col("rows") != rows_read), "changed")
        .otherwise("ok")
    )
    return every.select("file", "bytes", "rows", "bytes_now", rows_read.alias("rows_read"), status.alias("status"))


def absent(listed: DataFrame, read: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``listed`` whose key has nothing in ``read``.

    ``read`` is reduced to its keys before the join, so a key with a third of all rows is one row there.
    """
    return listed.join(read.select(*keys).distinct(), list(keys), "left_anti")
