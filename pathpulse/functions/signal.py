"""Signal transforms of one segment that built-in functions cannot express, as Arrow functions.

Each takes one array per segment (at most a segment's frames) and returns a struct whose last field is an error
message: a segment that cannot be computed gets a message and no values, and the others are not affected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = T.DoubleType()
NUMBERS = T.ArrayType(NUMBER)
ERROR = T.StructField("error", T.StringType())
SUMMARY = T.StructType([T.StructField("strongest", NUMBER), T.StructField("centroid", NUMBER), ERROR])
BANDS = T.StructType([T.StructField("values", NUMBERS), ERROR])

# The eight low-pass taps of the Daubechies wavelet with four vanishing moments.
DB4_LOW = np.array(
    [
        -0.010597401784997278,
        0.032883011666982945,
        0.030841381835986965,
        -0.18703481171888114,
        -0.02798376941698385,
        0.6308807679295904,
        0.7148465705525415,
        0.23037781330885523,
    ]
)
DB4_HIGH = DB4_LOW[::-1] * np.where(np.arange(8) % 2 == 0, -1.0, 1.0)


def wavelet_spread(x: np.ndarray, max_level: int = 3) -> list[float]:
    """Standard deviation of each coefficient band, coarsest first; absent bands are 0."""
    bands = [0.0] * (max_level + 1)
    level = min(max_level, int(np.log2(len(x))) - 1) if len(x) >= 4 else 0
    if level <= 0:
        return bands
    approx, details = x, []
    for _ in range(level):
        extended = np.pad(approx, len(DB4_LOW) - 1, "symmetric")
        details.append(np.convolve(extended, DB4_HIGH, "valid")[1::2])
        approx = np.convolve(extended, DB4_LOW, "valid")[1::2]
    for i, band in enumerate([approx, *reversed(details)]):
        bands[i] = float(np.std(band))
    return bands


def smooth(x: np.ndarray, sigma: float = 3.0, radius: int = 12) -> np.ndarray:
    """Gaussian smoothing with the signal mirrored at its ends."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, radius, "symmetric"), weights / weights.sum(), "valid")


def spectrum(x: np.ndarray) -> tuple[float, float]:
    """0-based position of the strongest frequency after the mean, and the magnitude-weighted mean."""
    if len(x) < 8:
        return 0.0, 0.0
    magnitude = np.abs(np.fft.rfft(x))[1 : len(x) // 2]
    order = np.arange(1, len(magnitude) + 1)
    strongest = int(np.argmax(np.round(magnitude, 9)))
    return float(strongest), float((order * magnitude).sum() / (magnitude.sum() + 1e-6))


def _known(values) -> np.ndarray:
    if values is None:
        return np.empty(0)
    array = np.asarray(values, dtype=float)
    if np.isinf(array).any():
        raise ValueError("a value is not finite")
    return array[~np.isnan(array)]


def tried(signals: pd.Series, work: Callable[[np.ndarray], list], width: int) -> list[list]:
    """``work`` on every signal: its ``width`` results and None, or no results and what went wrong."""
    out = []
    for values in signals:
        try:
            out.append([*work(_known(values)), None])
        except Exception as wrong:  # noqa: BLE001 - a bad segment is reported in its own row
            out.append([*[None] * width, f"{type(wrong).__name__}: {wrong}"])
    return out


@F.pandas_udf(BANDS)
def wavelet_bands(signal: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(tried(signal, lambda x: [wavelet_spread(x)], 1), columns=["values", "error"])


@F.pandas_udf(BANDS)
def smoothed(signal: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(tried(signal, lambda x: [smooth(x) if len(x) else []], 1), columns=["values", "error"])


@F.pandas_udf(SUMMARY)
def spectrum_summary(signal: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(tried(signal, lambda x: list(spectrum(x)), 2), columns=["strongest", "centroid", "error"])
