"""Fourier spectrum of whole tracks.

A track that fits an array is transformed in one call. A longer one is transformed over the cluster:
its transform of arbitrary length becomes a convolution with a chirp, and each power-of-two transform
is done as two rounds of short ones, grouped by column and then by row of a square layout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathpulse.functions.signal import spectrum_summary
from pathpulse.operators.long_tracks import CHANNEL, channel_values, positions
from pathpulse.session import cut_lineage

ARRAY_FRAMES = 1 << 20

_PAIRS = T.StructType(
    [T.StructField("re", T.ArrayType(T.DoubleType())), T.StructField("im", T.ArrayType(T.DoubleType()))]
)


@F.pandas_udf(_PAIRS)
def _short_transform(
    at: pd.Series, re: pd.Series, im: pd.Series, size: pd.Series, inverse: pd.Series
) -> pd.DataFrame:
    """Transform of one column or row; absent entries are 0."""
    out = []
    for places, a, b, n, back in zip(at, re, im, size, inverse):
        line = np.zeros(int(n), dtype=complex)
        line[np.asarray(places, dtype=int)] = np.asarray(a) + 1j * np.asarray(b)
        done = np.fft.ifft(line) if back else np.fft.fft(line)
        out.append((done.real, done.imag))
    return pd.DataFrame(out, columns=["re", "im"])


def _round(rows: DataFrame, group: str, place: str, size: str, inverse: bool) -> DataFrame:
    """Transform the lines sharing ``group`` along ``place``; results are numbered ``k``."""
    shape = ["total", "wide", "high"]
    lines = rows.groupBy(*CHANNEL, *shape, group).agg(
        F.collect_list(F.struct(F.col(place).alias("p"), "re", "im")).alias("e")
    )
    done = lines.withColumn(
        "t", _short_transform("e.p", "e.re", "e.im", size, F.lit(inverse))
    )
    zipped = F.arrays_zip(F.col("t.re").alias("re"), F.col("t.im").alias("im"))
    return done.select(*CHANNEL, *shape, group, F.posexplode(zipped).alias("k", "c")).select(
        *CHANNEL, *shape, group, F.col("k").cast("long").alias("k"),
        F.col("c.re").alias("re"), F.col("c.im").alias("im"),
    )


def _turned(re: Column, im: Column, angle: Column) -> dict[str, Column]:
    return {
        "re": re * F.cos(angle) - im * F.sin(angle),
        "im": re * F.sin(angle) + im * F.cos(angle),
    }


def _transform(rows: DataFrame, inverse: bool = False) -> DataFrame:
    """Transform of ``(channel, total, wide, high, j, re, im)`` with ``total = wide * high``."""
    laid = rows.withColumns(
        {"column": F.col("j") % F.col("wide"), "row": F.floor(F.col("j") / F.col("wide"))}
    )
    first = _round(laid, "column", "row", "high", inverse).withColumnRenamed("k", "line")
    angle = (
        F.lit(2 * np.pi if inverse else -2 * np.pi) * F.col("column") * F.col("line") / F.col("total")
    )
    second = _round(
        first.withColumns(_turned(F.col("re"), F.col("im"), angle)), "line", "column", "wide", inverse
    )
    return second.withColumn("j", F.col("line") + F.col("high") * F.col("k")).drop("line", "k")


def _long_magnitudes(placed: DataFrame) -> DataFrame:
    """``(channel, n, k, a)``: magnitude at every frequency below half the length."""
    bits = F.ceil(F.log2((2 * F.col("n") - 1).cast("double")) - 1e-12)
    half = F.floor(bits / 2)
    shaped = placed.withColumns(
        {
            "wide": F.pow(F.lit(2.0), half).cast("long"),
            "high": F.pow(F.lit(2.0), bits - half).cast("long"),
        }
    ).withColumn("total", F.col("wide") * F.col("high"))
    # the square of a position is reduced before it becomes an angle, or its digits would be lost
    square = F.col("pos").cast("decimal(19,0)") * F.col("pos").cast("decimal(19,0)")
    angle = (square % (2 * F.col("n")).cast("decimal(19,0)")).cast("double") * np.pi / F.col("n")
    turned = shaped.withColumn("angle", angle)
    shape = [*CHANNEL, "total", "wide", "high"]
    signal = turned.select(
        *shape, F.col("pos").alias("j"), (F.col("v") * F.cos("angle")).alias("re"),
        (-F.col("v") * F.sin("angle")).alias("im"),
    )
    chirp = turned.select(
        *shape,
        F.explode(
            F.array_distinct(F.array(F.col("pos"), (F.col("total") - F.col("pos")) % F.col("total")))
        ).alias("j"),
        F.cos("angle").alias("re"),
        F.sin("angle").alias("im"),
    )
    a = _transform(signal)
    b = _transform(chirp).select(*shape, "j", F.col("re").alias("bre"), F.col("im").alias("bim"))
    product = a.join(b, [*shape, "j"]).select(
        *shape, "j",
        (F.col("re") * F.col("bre") - F.col("im") * F.col("bim")).alias("re"),
        (F.col("re") * F.col("bim") + F.col("im") * F.col("bre")).alias("im"),
    )
    lengths = placed.groupBy(*CHANNEL).agg(F.min("n").alias("n"))
    return (
        _transform(product, inverse=True)
        .join(lengths, CHANNEL)
        .where((F.col("j") >= 1) & (F.col("j") < F.floor(F.col("n") / 2)))
        .select(
            *CHANNEL, F.col("j").alias("k"),
            F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("a"),
        )
    )


def spectrum_features(frames: DataFrame, array_frames: int = ARRAY_FRAMES) -> DataFrame:
    """Strongest frequency and magnitude-weighted mean frequency of speed and turning per entity."""
    placed = cut_lineage(positions(channel_values(frames), CHANNEL).where(F.col("n") >= 8))
    short = placed.where(F.col("n") <= array_frames)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"])
    found = (
        short.groupBy(*CHANNEL)
        .agg(ordered.alias("signal"))
        .withColumn("s", spectrum_summary("signal"))
        .select(*CHANNEL, "s.strongest", "s.centroid")
    )
    long = placed.where(F.col("n") > array_frames)
    if long.limit(1).count():
        strength = F.struct(F.round("a", 9), -F.col("k"))
        summed = _long_magnitudes(long).groupBy(*CHANNEL).agg(
            (F.max_by("k", strength) - 1).cast("double").alias("strongest"),
            (F.sum(F.col("k") * F.col("a")) / (F.sum("a") + 1e-6)).alias("centroid"),
        )
        found = found.unionByName(summed)
    return found.groupBy("entity").agg(
        *[
            F.coalesce(F.max(F.when(F.col("name") == name, F.col(column))), F.lit(0.0)).alias(out)
            for name in ("speed", "turning")
            for column, out in (
                ("strongest", f"{name}_dominant_freq"), ("centroid", f"{name}_spectral_centroid")
            )
        ]
    )
