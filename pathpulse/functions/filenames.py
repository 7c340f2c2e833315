"""Identity, label and lookup key held in file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The track file pattern, the folders left out and the names that are not tracks.
TRACK_PATTERN = r"coordinates_highestspeed_(\d{8})_(\d+)_(\d+)"
EXCLUDED_FOLDERS = ("Optogenetics", "COMPANY DRUG", "TERBINAFINE_OLD")
NON_TRACK_NAMES = r"(?i)summary|metadata|labels"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def lookup_key(path: Column) -> Column:
    """``coordinates_highestspeed_20240827_1_1.csv`` → ``/20240827_piworm01_1``; other names → null."""
    name = base_name(path)
    number = F.regexp_extract(name, TRACK_PATTERN, 2)
    # left-pad to two digits without cutting longer numbers
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    key = F.concat(
        F.lit("/"),
        F.regexp_extract(name, TRACK_PATTERN, 1),
        F.lit("_piworm"),
        padded,
        F.lit("_"),
        F.regexp_extract(name, TRACK_PATTERN, 3),
    )
    return F.when(name.rlike(TRACK_PATTERN), key)


def path_label(folder: Column) -> Column:
    """1 for treated animals: their directory path holds a plus sign."""
    return F.when(F.contains(folder, F.lit("+")), 1).otherwise(0)


def entity_of(filename: Column) -> Column:
    """Animal name of a segment or full-track file name."""
    return F.when(
        filename.rlike(r"segment\d+"), F.regexp_replace(filename, r"-segment\d+.*", "")
    ).otherwise(F.regexp_replace(filename, r"-preprocessed.*", ""))


def segment_of(filename: Column) -> Column:
    """Segment number in a file name, 0 where there is none."""
    digits = F.nullif(F.regexp_extract(filename, r"segment(\d+)", 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def segment_or_extracted(segment_index: Column, filename: Column) -> Column:
    """Stored segment index, else the (possibly decimal) number in the file name."""
    digits = F.nullif(F.regexp_extract(filename, r"segment(\d+(?:\.\d+)?)", 1), F.lit(""))
    return F.coalesce(segment_index.cast("double"), digits.try_cast("double"))
