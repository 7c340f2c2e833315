"""Sequences packed by deficit round-robin over source queues.

Every source is a queue of documents. A round adds a window's tokens to the sources' deficits in the target
proportions and serves each source its deficit in whole quanta; what is left stays for later windows. Since
deficits follow from the round's number alone, each task finds the place of its documents in the stream from
their place in their queue: deficits carry over windows and partitions without passing tokens around.
The stream is cut into sequences of ``size`` tokens, and what remains at its end into powers of two, so no
sequence needs padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathpulse.llm.pieces import byte_letters, pieces
from pathpulse.llm.store import keep
from pathpulse.llm.tokens import read_vocabulary
from pathpulse.llm.words import as_binary, texts

#: Most sources of one mixture, and most rows of offsets that are broadcast (else they are joined).
MOST_SOURCES, MOST_BROADCAST = 10_000, 200_000
#: Pieces whose ids a worker remembers, and documents that are cut at a time.
REMEMBERED, AT_ONCE = 200_000, 1_000


@dataclass(frozen=True)
class Packing:
    """``window`` tokens a round, served in quanta of ``quantum`` tokens (the bound of a carried deficit)."""

    size: int = 1024
    window: int = 1024
    quantum: int = 256
    end: int = 0


@dataclass
class Phase:
    """A stretch of the stream in which the same queues have tokens: per source first token and tokens."""

    begins: np.ndarray
    tokens: np.ndarray
    at: int


class Mixture:
    """Places in the stream for places in the queues of sources with ``totals`` tokens."""

    def __init__(self, totals: np.ndarray, targets: np.ndarray, p: Packing):
        self.p, self.phases, self.total = p, [], int(totals.sum())
        left, at = totals.astype(np.int64), 0
        while left.any():
            rates = np.where(left > 0, targets, 0.0)
            if not rates.any():
                rates = left.astype(float)
            rates = rates / rates.sum()
            lengths = np.divide(left, rates, out=np.full(len(left), np.inf), where=rates > 0)
            tokens = np.minimum(left, np.rint(rates * lengths.min()).astype(np.int64))
            tokens[lengths <= lengths.min() * (1 + 1e-12)] = left[lengths <= lengths.min() * (1 + 1e-12)]
            self.phases.append(Phase(totals - left, tokens, at))
            left, at = left - tokens, at + int(tokens.sum())
        full = self.total // p.size * p.size
        rest, cuts, end = self.total - full, [], full
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                cuts.append(end)
                end += 1 << bit
        self.full, self.cuts = full, np.array(cuts, np.int64)

    def _served(self, phase: Phase, source: np.ndarray | int, rounds: np.ndarray) -> np.ndarray:
        """Tokens of a source that the first ``rounds`` rounds of a phase serve."""
        tokens, p = phase.tokens[source], self.p
        last = -(-int(phase.tokens.sum()) // p.window)
        quanta = np.floor(rounds * (tokens * (p.window / p.quantum) / phase.tokens.sum())).astype(np.int64)
        return np.where(rounds >= last, tokens, np.minimum(tokens, quanta * p.quantum))

    def _round(self, phase: Phase, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Number, from 0, of the round that serves the quantum that begins at ``place``."""
        p = self.p
        last = -(-int(phase.tokens.sum()) // p.window)
        rate = phase.tokens[source] * (p.window / p.quantum) / phase.tokens.sum()
        n = np.clip(np.ceil((place // p.quantum + 1) / rate).astype(np.int64) - 2, 0, last - 1)
        while True:
            late = (self._served(phase, source, n + 1) <= place) & (n < last - 1)
            if not late.any():
                return n
            n = n + late

    def places(self, doc: np.ndarray, source: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """Pieces (doc, start in the document, length, sequence, offset) of documents in their queues."""
        p, found = self.p, []
        for phase in self.phases:
            low = phase.begins[source]
            a, b = np.maximum(begin, low), np.minimum(begin + length, low + phase.tokens[source])
            some = a < b
            d, s, a, b, skip = doc[some], source[some], (a - low)[some], (b - low)[some], (low - begin)[some]
            d, s, skip, a, b = _cut(p.quantum, (d, s, skip), a, b)
            if not len(d):
                continue
            first = a // p.quantum * p.quantum
            turn = self._round(phase, s, first)
            stream = phase.at + a - self._served(phase, s, turn)
            for k in np.flatnonzero(phase.tokens):
                stream += self._served(phase, k, turn)
                stream += np.where(s > k, self._served(phase, k, turn + 1) - self._served(phase, k, turn), 0)
            d, start, x, y = _cut(p.size, (d, skip + a - stream), stream, stream + b - a)
            found.append((d, start + x, x, y))
        d, start, x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*found)) or [()] * 4))
        d, start, x, y = self._cut_tail(d, start, x, y)
        sequence, base = x // p.size, x // p.size * p.size
        tail = x >= self.full
        if tail.any():
            k = np.searchsorted(self.cuts, x[tail], "right") - 1
            sequence[tail], base[tail] = self.full // p.size + k, self.cuts[k]
        order = np.lexsort((start, d))
        d, start, size, sequence, offset = d[order], start[order], (y - x)[order], sequence[order], (x - base)[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + size[:-1])
        at = np.flatnonzero(new)
        size = np.add.reduceat(size, at) if len(at) else size
        return d[at], start[at], size, sequence[at], offset[at]

    def _cut_tail(self, d, start, x, y):
        if not len(self.cuts):
            return d, start, x, y
        inner = y > self.full
        rows = [(d[~inner], start[~inner], x[~inner], y[~inner])]
        bounds = np.append(self.cuts, self.total)
        for a, b in zip(bounds[:-1], bounds[1:]):
            lo, hi = np.maximum(x, a), np.minimum(y, b)
            some = inner & (lo < hi)
            rows.append((d[some], (start + lo - x)[some], lo[some], hi[some]))
        return tuple(np.concatenate(c) for c in zip(*rows))


def _cut(grid: int, columns: tuple, a: np.ndarray, b: np.ndarray):
    """Split the ranges [a, b) at multiples of ``grid``; columns repeat."""
    n = (b - 1) // grid - a // grid + 1
    row = np.repeat(np.arange(len(a)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    edge = (a // grid)[row] * grid + step * grid
    return *(c[row] for c in columns), np.maximum(a[row], edge), np.minimum(b[row], edge + grid)


class Encoder:
    """Ids of distinct pieces, remembered over the tasks of a worker.

    A merge list whose merged symbols are numbered in the order of its merges, as byte-level vocabularies are, can be
    given to tiktoken as ranks, which encodes a single piece several times faster than tokenizers does.
    """

    def __init__(self, content: str):
        file = json.loads(content)
        vocabulary, letters = file["model"]["vocab"], {x: b for b, x in enumerate(byte_letters())}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary does not number its merges in their order")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.added = tuple(self.special)
        ranks = {bytes(letters[x] for x in token): n for token, n in vocabulary.items() if token not in self.special}
        self.library = tiktoken.Encoding("pieces", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.known: dict[str, bytes] = {}

    def __call__(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, kind = self.known, np.uint16 if self.width == 2 else np.uint32
        if len(known) > REMEMBERED:
            known.clear()
        parts = []
        for x in found:
            ids = known.get(x)
            if ids is None:
                special = self.special.get(x)
                ids = np.array(self.library.encode_ordinary(x) if special is None else [special], kind).tobytes()
                if len(x) < 64:
                    known[x] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), kind), np.cumsum([0, *(len(x) // self.width for x in parts)])


@cache
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def _gather(ids: np.ndarray, of: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``order`` of a ragged array, one after the other, and where each begins."""
    n = np.diff(of)[order]
    at = np.concatenate(([0], np.cumsum(n)))
    return ids[np.repeat(of[order] - at[:-1], n) + np.arange(at[-1])], at


def tokenized(docs: DataFrame, p: Packing, path: str | None, doc_id: str, text: str, source: str) -> DataFrame:
    """task, doc_id, source, first token in the task's part of the source's queue, and ids with the end."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, queues = _encoder(content.value), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in texts(batch.column(2)):
                found = pieces(part, encode.added)
                ids, of = encode(found.distinct)
                flat, at = _gather(ids, of, found.order)
                ends = at[found.of]
                flat = np.insert(flat, ends[1:], p.end)
                ends = ends + np.arange(len(ends))
                sources = batch.column(1).slice(part.first, len(part))
                begins = []
                for s, n in zip(sources.to_pylist(), np.diff(ends).tolist()):
                    begins.append(queues.get(s, 0))
                    queues[s] = begins[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), task)),
                        batch.column(0).slice(part.first, len(part)),
                        sources,
                        pa.array(begins, pa.int64()),
                        pa.array(np.diff(ends)),
                        as_binary(flat, ends),
                    ],
                    names=["task", "doc_id", "source", "begin", "doc_tokens", "ids"],
                )

    columns = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(text).cast("string").alias("text"),
    )
    kind = columns.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(run, f"task long, doc_id {kind}, source string, begin long, doc_tokens long, ids binary")


def pack(
    docs: DataFrame,
    p: Packing = Packing(),
    targets: Mapping[str, float] | None = None,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in mixture-controlled sequences.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and, if asked for,
    the ids. ``targets`` weighs the sources; without it they keep the corpus' own proportions. A source
    that runs dry leaves its share to the others; sources without a target come last. A null text is empty
    (one token, the end); a null source shares the queue of the empty name. Repeated rows are packed each;
    other columns are ignored; an empty table gives no pieces. More than 10,000 sources raise ValueError.
    """
    rows = keep(tokenized(docs, p, path, doc_id, text, source))
    sums = keep(rows.groupBy("task", "source").agg(F.sum("doc_tokens").alias("tokens")))
    found = sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mixture has at most {MOST_SOURCES} sources")
    names = {r.source: k for k, r in enumerate(found)}
    totals = np.array([r.tokens for r in found], np.int64)
    weights = totals.astype(float) if targets is None else np.array([float(targets.get(s, 0)) for s in names])
    mixture = Mixture(totals, weights, p)
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("task", "source", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    if sums.count() <= MOST_BROADCAST:
        offsets = F.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            at = np.frombuffer(batch.column(4).buffers()[1], np.int32)[batch.column(4).offset :][: batch.num_rows + 1].astype(np.int64)
            width = int((at[-1] - at[0]) // max(1, np.sum(batch.column(3).to_numpy())))
            data = batch.column(4).buffers()[2]
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint16 if width == 2 else np.uint32)
            first = (at - at[0]) // width
            source = np.array([names[s] for s in batch.column(1).to_pylist()])
            begin, length = (batch.column(k).to_numpy() for k in (2, 3))
            d, start, size, sequence, offset = mixture.places(np.arange(batch.num_rows), source, begin, length)
            wide = memoryview(raw.astype("<u4")).cast("B")
            spans = list(zip((4 * (first[d] + start)).tolist(), (4 * size).tolist()))
            out = [
                batch.column(0).take(pa.array(d)),
                pa.array(start),
                pa.array(size),
                pa.array([zlib.crc32(wide[a : a + n]) for a, n in spans], pa.int64()),
                pa.array(length[d]),
                pa.array(sequence),
                pa.array(offset),
                batch.column(1).take(pa.array(d)),
            ]
            if with_ids:
                out.append(pa.array([np.frombuffer(wide[a : a + n], np.int32) for a, n in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=fields)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    schema += ", ids array<int>" if with_ids else ""
    fields = [x.split()[0] for x in schema.split(", ")]
    placed = rows.join(offsets, ["task", "source"]).select(
        "doc_id", "source", (F.col("begin") + F.col("before")).alias("begin"), "doc_tokens", "ids"
    )
    return placed.mapInArrow(run, schema)
