"""Benchmark passages in documents, found by spaced seeds.

A seed looks at the words under its mask and ignores those between, so it hits in spite of words replaced
there. The two masks for long items find every stretch of 13 words with up to two words replaced, wherever
they stand; four words in a row find stretches of 8 to 12 words with one replaced. Seeds of documents
are joined with those of the test items, and every hit is verified along its diagonal.

The test items are dealt into blocks of bounded size. A block's index is broadcast and all documents
pass it once, so nothing is shuffled and no text or item is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.words import Words, mix, texts, words

# Positions that the masks look at, lossless for (13 words, 2 replaced) and (8 words, 1 replaced).
LONG_MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORT_MASKS = ((0, 1, 2, 3),)
WINDOW, LEAST = 13, 8
_BITS = 22


@dataclass(frozen=True)
class Decontamination:
    """Most bytes of test items in one broadcast block."""

    block_bytes: int = 16 << 20


def _replaced(n: int) -> int:
    """Words that may be replaced in a window of n words."""
    return 2 if n >= WINDOW else 1


def _seeds(hashes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Seed hash at every place where the mask fits into the array."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for k in mask:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def _ends(w: Words) -> np.ndarray:
    """For every word, where the words of its text end."""
    return np.repeat(w.of[1:], np.diff(w.of))


class Index:
    """Seeds of some test items; ``rows`` are pairs of item id and text."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        parts = [words(p, fold=True) for p in texts(pa.array([r[1] for r in rows], pa.large_string()), 1 << 62)]
        self.words = parts[0] if parts else Words(*[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64), np.zeros(1, np.int64))
        size = np.diff(self.words.of)
        self.whole = {}
        for k in np.flatnonzero((size > 0) & (size < LEAST)).tolist():
            self.whole.setdefault(self.words.hashes[self.words.of[k] : self.words.of[k + 1]].tobytes(), []).append(k)
        ends, of_word = _ends(self.words), np.repeat(size, size)
        self.tables = []
        for number, mask in enumerate(LONG_MASKS + SHORT_MASKS):
            seeds = _seeds(self.words.hashes, mask, number)
            fits = np.arange(len(seeds)) + mask[-1] < ends[: len(seeds)]
            n = of_word[: len(seeds)]
            fits &= (n >= WINDOW) if mask in LONG_MASKS else (n >= LEAST) & (n < WINDOW)
            at = np.flatnonzero(fits)
            at = at[np.argsort(seeds[at], kind="stable")]
            seen = np.zeros(1 << _BITS, bool)
            seen[(seeds[at] & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.tables.append((number, mask, seeds[at], at, seen))
        self.item = np.repeat(np.arange(len(size)), size)

    def hits(self, w: Words) -> np.ndarray:
        """Distinct (text, item, diagonal) of all seed hits, sorted."""
        ends, text = _ends(w), w.text_ids()
        found = [np.zeros((0, 3), np.int64)]
        for number, mask, keys, places, seen in self.tables:
            if not len(keys):
                continue
            seeds = _seeds(w.hashes, mask, number)
            spots = np.flatnonzero(seen[(seeds & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            spots = spots[spots + mask[-1] < ends[spots]]
            low, high = (np.searchsorted(keys, seeds[spots], side) for side in ("left", "right"))
            n = high - low
            spots, low, n = spots[n > 0], low[n > 0], n[n > 0]
            row = np.repeat(np.arange(len(spots)), n)
            place = places[low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
            spot = spots[row]
            found.append(np.column_stack([text[spot], self.item[place], spot - place]))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, w: Words) -> list[tuple[int, int, int, int, int, int]]:
        """Best verified overlap of every text with every item: text, item, begin and end in the text, begin in
        the item, equal words; places count words."""
        best: dict[tuple[int, int], tuple] = {}
        for text, item, diagonal in self.hits(w).tolist():
            a, b = int(self.words.of[item]), int(self.words.of[item + 1])
            x, y = int(w.of[text]), int(w.of[text + 1])
            low, high = max(a, x - diagonal), min(b, y - diagonal)
            size = min(WINDOW, b - a)
            if high - low < size:
                continue
            equal = self.words.hashes[low:high] == w.hashes[low + diagonal : high + diagonal]
            sums = np.concatenate(([0], np.cumsum(equal)))
            good = np.flatnonzero(sums[size:] - sums[:-size] >= size - _replaced(size))
            if len(good):
                first, last = int(good[0]), int(good[-1]) + size
                matched = int(sums[last] - sums[first])
                row = (matched, -(low + diagonal + first - x), last - first, low + first - a)
                if row > best.get((text, item), (0,)):
                    best[text, item] = row
        out = [(t, i, -r[1], -r[1] + r[2], r[3], r[0]) for (t, i), r in best.items()]
        if self.whole:
            size = np.diff(w.of)
            for t in np.flatnonzero((size > 0) & (size < LEAST)).tolist():
                for i in self.whole.get(w.hashes[w.of[t] : w.of[t + 1]].tobytes(), []):
                    out.append((t, i, 0, int(size[t]), 0, int(size[t])))
        return out


@lru_cache(maxsize=2)
def _index(rows: tuple) -> Index:
    return Index(list(rows))


def _blocks(benchmark: DataFrame, p: Decontamination, item_id: str, text: str) -> Iterator[tuple]:
    """The test items, a block of bounded bytes at a time, on the driver."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = 1 + size // p.block_bytes
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield tuple((r.id, r.text) for r in rows.distinct().collect())


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    p: Decontamination = Decontamination(),
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Overlaps of documents with test items, one row for each pair that has one.

    doc_id, item_id, doc_start and doc_end, item_start (places count words) and matched (equal words). An
    overlap has a window of 13 words (or all words of an item of 8 to 12) with at most two (one) replaced; A-Z
    count as a-z. Items of fewer than 8 words prove nothing inside a text: they match whole equal texts only.
    Null, empty and blank texts and items overlap nothing. Repeated documents give a row each, repeated
    items one; other columns are ignored; empty tables give an empty result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    out = None
    for rows in _blocks(benchmark, p, item_id, text):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent.value)
            for batch in batches:
                for part in texts(batch.column(1)):
                    found = index.overlaps(words(part, fold=True))
                    if found:
                        text_, item, *places = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).slice(part.first).take(pa.array(text_, pa.int64())),
                                pa.array([index.ids[k] for k in item]),
                                *(pa.array(c, pa.int64()) for c in places),
                            ],
                            names=["doc_id", "item_id", "doc_start", "doc_end", "item_start", "matched"],
                        )

        schema = f"doc_id {kind}, item_id {item_kind}, doc_start long, doc_end long, item_start long, matched long"
        block = source.mapInArrow(run, schema)
        out = block if out is None else out.unionByName(block)
    return out


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap no test item (see ``contaminated``)."""
    place = docs.columns.index(text)
    for rows in _blocks(benchmark, p, item_id, text):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for part in texts(batch.column(place)):
                    clean[[part.first + x[0] for x in index.overlaps(words(part, fold=True))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
