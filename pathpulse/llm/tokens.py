"""Token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.pieces import Vocabulary, pieces, vocabulary
from pathpulse.llm.words import texts

#: Pieces whose counts a worker remembers; the memory starts anew when it is full.
REMEMBERED = 400_000


def count_merged(symbols: list[int], pairs: dict[int, int]) -> int:
    """Symbols left after merging: repeatedly the leftmost adjacent pair of the lowest rank.

    The symbols form a linked list; the heap holds rank and place of every pair that was adjacent once, and
    an entry whose place no longer holds that pair is passed over.
    """
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for k in range(n - 1):
        entry = pairs.get(symbols[k] << 20 | symbols[k + 1])
        if entry is not None:
            heap.append((entry, k))
    heapify(heap)
    left = n
    while heap:
        entry, k = heappop(heap)
        second = after[k]
        if second >= n or symbols[k] < 0 or pairs.get(symbols[k] << 20 | symbols[second]) != entry:
            continue
        symbols[k] = entry & 0xFFFFF
        symbols[second] = -1
        third = after[k] = after[second]
        left -= 1
        if third < n:
            before[third] = k
            entry = pairs.get(symbols[k] << 20 | symbols[third])
            if entry is not None:
                heappush(heap, (entry, k))
        first = before[k]
        if first >= 0:
            entry = pairs.get(symbols[first] << 20 | symbols[k])
            if entry is not None:
                heappush(heap, (entry, first))
    return left


class Counter:
    """Token counts of distinct pieces, remembered over the tasks of a worker."""

    def __init__(self, content: str):
        self.vocabulary: Vocabulary = vocabulary(content)
        self.known: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        known, pairs, symbol = self.known, self.vocabulary.pairs, self.vocabulary.bytes_
        if len(known) > REMEMBERED:
            known.clear()
        out = np.empty(len(found), np.int64)
        for k, piece in enumerate(found):
            n = known.get(piece)
            if n is None:
                if piece in self.vocabulary.added:
                    n = 1
                else:
                    n = count_merged([symbol[b] for b in piece.encode()], pairs)
                if len(piece) < 64:
                    known[piece] = n
            out[k] = n
        return out


@cache
def counter(content: str) -> Counter:
    return Counter(content)


def read_vocabulary(path: str | None) -> str:
    """Text of a vocabulary file, by default the byte-level one of the installed public tokenizers."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def token_counts(docs: DataFrame, limit: int = 1024, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Null and empty texts have no bytes and no tokens. Strings of added tokens inside a text count one token
    each, the library's default. Rows that repeat and rows without id are counted like others; other columns
    are ignored; an empty table gives an empty result. The driver reads the vocabulary file and broadcasts
    its text (a few MB, whatever the corpus).
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(content.value)
        for batch in batches:
            for part in texts(batch.column(1)):
                found = pieces(part, count.vocabulary.added)
                n = np.concatenate(([0], np.cumsum(count(found.distinct)[found.order])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        pa.array(np.diff(part.at)),
                        pa.array(total := np.diff(n[found.of])),
                        pa.array(total > limit),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
