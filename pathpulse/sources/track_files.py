"""Track CSV files, the lifespan lookup and the bounds scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathpulse.functions import filenames
from pathpulse.session import stored
from pathpulse.sources.manifest import decoded, listed_files, relative_path

LIFESPAN_SCHEMA = "Filename STRING, Seconds5x DOUBLE"


def null_if_nan(df: DataFrame, *columns: str) -> DataFrame:
    """Missing is null from here on: aggregates skip null but not NaN."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


# A comma outside of quotes: an even number of quotes follows it.
_SEPARATOR = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def cells_of(line: Column) -> Column:
    """Cells of a CSV line without the blanks and quotes around them; a comma inside quotes does not split."""
    cells = F.when(F.contains(line, F.lit('"')), F.split(line, _SEPARATOR)).otherwise(F.split(line, ","))
    return F.transform(cells, lambda c: F.regexp_replace(c, '^[\\s\ufeff]*"?\\s*|\\s*"?\\s*$', ""))


def _cell(name: str) -> Column:
    """Cell of a named column as text; null where the file or the line has no such column."""
    return F.get("cells", F.array_position("names", name).cast("int") - 1)


def _number(name: str, kind: str = "double") -> Column:
    """Cell of a named column as a number; null where there is none."""
    return _cell(name).try_cast(kind)


def csv_lines(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Lines of all files below ``folder`` as ``(path, row_no, cells, names)``, by each file's own header.

    ``row_no`` is the 0-based line after the header, blank lines aside. Within one file split the generated id
    counts up by one, so a line number is the id's distance from the first id of its split plus the lines of
    the earlier splits of that file; only the per-split counts are ordered, never the rows. The lines are stored with
    their ids, since another scan might be split otherwise and number them anew.
    """
    raw = stored(
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("ignoreCorruptFiles", "true")
        .text(folder)
        .where(F.trim("value") != "")
        .select(
            "value",
            decoded(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"),
        )
    )
    splits = raw.groupBy("path", "split").agg(
        F.count(F.lit(1)).alias("lines"), F.min("id").alias("first_id"), F.min_by("value", "id").alias("head")
    )
    in_file = Window.partitionBy("path").orderBy("split")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "path", "split", "first_id", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("start"),
        cells_of(F.first("head").over(in_file)).alias("names"),
    )
    place = F.col("id") - F.col("first_id") + F.col("start")
    return (
        raw.join(starts, ["path", "split"])
        .where(place > 0)
        .select("path", (place - 1).alias("row_no"), cells_of(F.col("value")).alias("cells"), "names")
    )


# The columns that a track file has.
TRACK_COLUMNS = ("GlobalFrame", "Speed", "X", "Y")


def scan_report(spark: SparkSession, folder: str, listed: DataFrame | None = None, pattern: str = "*.csv") -> DataFrame:
    """``(relative_path, bytes, n_lines, short_lines, bad_cells, status)`` of every file, and of ``listed(relative_path)``.

    ``short_lines`` have fewer cells than the header, as the last one of a truncated file has; ``bad_cells`` are texts
    in number columns. ``status``: ``missing`` (listed, but gone or of no length, which Spark does not show), ``no lines``, ``no columns`` (the header lacks one of
    the track's), ``short lines``, ``bad cells`` or ``ok``.
    """
    bad = sum(
        ((_cell(c) != "") & ~F.lower(_cell(c)).isin("nan", "na", "null") & _number(c).isNull()).cast("long") for c in TRACK_COLUMNS
    )
    lines = csv_lines(spark, folder, pattern).groupBy("path").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.size("cells") < F.size("names")).alias("short_lines"),
        F.coalesce(F.sum(F.coalesce(bad, F.lit(0))), F.lit(0)).alias("bad_cells"),
        F.first("names").alias("names"),
    )
    files = listed_files(spark, folder, pattern).join(lines, "path", "left")
    files = files.withColumn("relative_path", relative_path(F.col("path"), folder))
    if listed is not None:
        files = files.join(listed.select("relative_path").distinct(), "relative_path", "full")
    complete = F.forall(F.array(*[F.lit(c) for c in TRACK_COLUMNS]), lambda c: F.array_contains("names", c))
    status = (
        F.when(F.col("bytes").isNull(), "missing")
        .when(F.coalesce("n_lines", F.lit(0)) == 0, "no lines")
        .when(~complete, "no columns")
        .when(F.col("short_lines") > 0, "short lines")
        .when(F.col("bad_cells") > 0, "bad cells")
        .otherwise("ok")
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "short_lines", "bad_cells")]
    return files.select("relative_path", "bytes", *counts, status.alias("status"))


def scan_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """All track files below ``folder`` as ``(path, relative_path, entity, label, row_no, speed, x, y)``.

    Columns go by the names in each file's header, whatever their order. An entity is named after its file; where
    several folders hold a file of that name, after the file's path below ``folder``.
    """
    lines = csv_lines(spark, folder)
    excluded = reduce(
        lambda a, b: a | b,
        [F.array_contains(F.split("path", "/"), d) for d in filenames.EXCLUDED_FOLDERS],
    )
    name = filenames.base_name(F.col("path"))
    tracks = lines.where(~excluded & ~name.rlike(filenames.NON_TRACK_NAMES)).select(
        "path",
        "row_no",
        _number("GlobalFrame", "bigint").alias("global_frame"),
        _number("Speed").alias("speed"),
        _number("X").alias("x"),
        _number("Y").alias("y"),
    )
    files = (
        tracks.select("path").distinct()
        .withColumn("relative_path", relative_path(F.col("path"), folder))
        .withColumn("file", F.regexp_replace(name, r"\.csv$", ""))
    )
    shared = files.groupBy("file").agg(F.count(F.lit(1)).alias("files"))
    entity = F.when(F.col("files") == 1, F.col("file")).otherwise(F.regexp_replace("relative_path", r"\.csv$", ""))
    named = files.join(shared, "file").select("path", "relative_path", entity.alias("entity"))
    return null_if_nan(tracks, "speed", "x", "y").join(named, "path").select(
        "path",
        "relative_path",
        "entity",
        filenames.path_label(filenames.directory(F.col("path"))).alias("label"),
        "row_no",
        "global_frame",
        "speed",
        "x",
        "y",
    )


def file_dimension(tracks: DataFrame) -> DataFrame:
    """``(entity, file_id, original_file, relative_path)``: the file that each entity of a scan came from.

    ``relative_path`` is the folder below the scanned one, ``.`` for that itself, and ``file_id`` a hash of both.
    """
    inside = F.when(F.contains("relative_path", F.lit("/")), F.regexp_replace("relative_path", "/[^/]*$", "")).otherwise(".")
    return tracks.select("entity", "relative_path").distinct().select(
        "entity",
        F.xxhash64("relative_path").alias("file_id"),
        filenames.base_name(F.col("relative_path")).alias("original_file"),
        inside.alias("relative_path"),
    )


def with_file_identity(table: DataFrame, files: DataFrame) -> DataFrame:
    """Name the file of every row of a segment table (with ``seg``) or whole-track table: ``file_id file original_file
    relative_path``. ``file`` is the preprocessed file's name, with the segment number at segment grain.
    """
    bare = F.regexp_replace("original_file", r"\.csv$", "")
    part = F.concat(F.lit("-segment"), F.col("seg").cast("string")) if "seg" in table.columns else F.lit("")
    named = table.join(files, "entity").withColumn("file", F.concat(bare, part, F.lit("-preprocessed.csv")))
    return named.select(*table.columns, "file_id", "file", "original_file", "relative_path")


def frames_of(tracks: DataFrame) -> DataFrame:
    """Drop each file's first line, number the rest from 1."""
    return (
        tracks.where("row_no > 0")
        .withColumn("frame", F.col("row_no"))
        .select("path", "entity", "label", "frame", "speed", "x", "y")
    )


def read_lifespans(spark: SparkSession, path: str) -> DataFrame:
    """Lifespan lookup, one row per file key; the first line wins where a key repeats."""
    lines = (
        spark.read.schema(LIFESPAN_SCHEMA)
        .option("header", "true")
        .option("enforceSchema", "false")
        .csv(path)
        .withColumn("line", F.monotonically_increasing_id())
    )
    return (
        lines.groupBy(F.col("Filename").alias("key"))
        .agg(F.min_by("Seconds5x", "line").alias("seconds"))
    )


def scan_bounds_files(spark: SparkSession, *folders: str) -> DataFrame:
    """Raw and preprocessed files for the bounds scan, with either spelling of the coordinates.

    Speed and turning angle are those of the preprocessed spelling; a raw file's ``Speed`` is not one.
    """
    parts = [csv_lines(spark, folder) for folder in folders]
    lines = reduce(DataFrame.unionByName, parts)
    name = filenames.base_name(F.col("path"))
    wanted = name.contains("coordinates_highestspeed_") | name.contains("preprocessed")
    scanned = lines.where(wanted).select(
        "path",
        _number("speed").alias("speed"),
        F.coalesce(_number("X"), _number("x")).alias("x"),
        F.coalesce(_number("Y"), _number("y")).alias("y"),
        _number("turning_angle").alias("turning_angle"),
    )
    return null_if_nan(scanned, "speed", "x", "y", "turning_angle")
