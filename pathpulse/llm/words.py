"""Words of Arrow text columns as arrays of 64-bit hashes, a bounded slice of text at a time.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
Work goes over the column's own byte buffer, so no text is turned into Python strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RNG = np.random.default_rng(20240601)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = BYTE.copy()
_FOLDED[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, SLICE), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def span_hashes(values: Callable[[int, int], np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span [start, end); spans ascend and ``values(a, b)`` gives the uint64 of symbols a to b."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        first, last = int(starts[at]), int(ends[to - 1])
        up, down = _power(last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(values(first, last) * up[: last - first], out=sums[1:])
        a, b = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


@dataclass
class Text:
    """Some texts in one byte array; text k is data[at[k]:at[k + 1]]."""

    first: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1


@dataclass
class Words:
    """Words of a Text in order; text k has the words of[k] to of[k + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    of: np.ndarray

    def text_ids(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def texts(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Text]:
    """Slices of a string column with at most ``limit`` bytes each, or one longer text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    k = 0
    while k < n:
        to = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        yield Text(k, data[at[k] : at[to]], at[k : to + 1] - at[k])
        k = to


def words(text: Text, fold: bool = False) -> Words:
    """The words of some texts; ``fold`` takes A-Z as a-z."""
    data, at = text.data, text.at
    inside = ~SPACE[data]
    begins, finishes = inside.copy(), inside.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    table = _FOLDED if fold else BYTE
    return Words(starts, ends, span_hashes(lambda a, b: table[data[a:b]], starts, ends), np.searchsorted(starts, at))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, text by text, and where each text's begin.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    counts = np.diff(w.of)
    full = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size)
    of = np.concatenate(([0], np.cumsum(full + short)))
    out = np.empty(of[-1], np.uint64)
    if len(w.hashes) >= size:
        n = len(w.hashes) - size + 1
        run = w.hashes[:n].copy()
        for k in range(1, size):
            run = mix(run * _BASE + w.hashes[k : k + n])
        last = np.repeat(w.of[1:], counts)[:n]
        whole = np.arange(n) + size <= last
        spot = np.repeat(full > 0, full + short)
        out[spot] = run[whole]
    for k in np.flatnonzero(short):
        run = np.uint64(counts[k])
        for h in w.hashes[w.of[k] : w.of[k + 1]]:
            run = mix(np.array([run], np.uint64) * _BASE + h)[0]
        out[of[k]] = run
    return out, of


def distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes of every text, and where each text's begin."""
    for a, b in zip(of[:-1], of[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    if len(hashes):
        new[1:] = hashes[1:] != hashes[:-1]
        new[of[:-1][np.diff(of) > 0]] = True
    seen = np.concatenate(([0], np.cumsum(new)))
    return hashes[new], seen[of]


def per_text(ufunc: np.ufunc, values: np.ndarray, of: np.ndarray, empty: int = 0) -> np.ndarray:
    """``ufunc`` over the values of every text; ``empty`` for texts without any."""
    out = np.full(len(of) - 1, empty, values.dtype)
    some = np.diff(of) > 0
    if some.any():
        out[some] = ufunc.reduceat(values, of[:-1][some])
    return out


def as_binary(data: np.ndarray, of: np.ndarray) -> pa.Array:
    """Rows of a flat array as binary values; row k is data[of[k]:of[k + 1]]."""
    data = np.ascontiguousarray(data)
    places = (np.asarray(of, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(of) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])
