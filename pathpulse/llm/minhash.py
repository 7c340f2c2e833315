"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``chunks * symbols`` symbols of 16 bits, one for each hash function. Two documents that
differ in at most ``distance`` symbols differ, by pigeonhole, in at most ``errors`` symbols of some
chunk; every chunk is therefore indexed under each choice of ``errors`` symbols left out, and such a
pair always meets under a common key. Pairs that meet and lie within ``distance`` form families; inside
a family all pairs are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathpulse.llm.store import components, in_blocks, keep, settled
from pathpulse.llm.words import as_binary, distinct, mix, per_text, shingles, texts, words


@dataclass(frozen=True)
class MinHash:
    """``shingle`` words per shingle; link at 100 * intersection >= percent * union.

    With 30 symbols in five chunks and two errors a chunk, all pairs that differ in up to 14 symbols
    meet. A pair at the limit of 80 % differs in 6 on average and in 15 or more with probability 0.0002.
    Up to ``most_broadcast`` rows of family members (16 bytes each) are broadcast to the texts; more are joined.
    """

    shingle: int = 5
    percent: int = 80
    chunks: int = 5
    symbols: int = 6
    errors: int = 2
    bucket_block: int = 512
    family_block: int = 256
    most_broadcast: int = 500_000

    @property
    def length(self) -> int:
        return self.chunks * self.symbols

    @property
    def distance(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, p: MinHash, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, two set hashes and the signature of every document (empty: no signature)."""
    flips, factors = _functions(p.length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part in texts(batch.column(1)):
                sets, of = distinct(*shingles(words(part, fold=True), p.shingle))
                sig = np.zeros((len(part), p.length), np.uint16)
                for k in range(p.length):
                    sig[:, k] = per_text(np.minimum, mix((sets ^ flips[k]) * factors[k]), of) & np.uint64(0xFFFF)
                hashes = [per_text(np.add, mix(sets ^ np.uint64(s)), of).view(np.int64) for s in (11, 12)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.first, len(part)),
                        pa.array(np.diff(of)),
                        *map(pa.array, hashes),
                        as_binary(sig.ravel(), np.arange(len(part) + 1) * p.length),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature"],
                )

    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _rows(batches: Iterator[pa.RecordBatch], keys: int, weight: int) -> Iterator[pa.Table]:
    """Whole groups of sorted rows (equal first ``keys`` columns) gathered until their squared sizes reach ``weight``."""
    held: list[pa.RecordBatch] = []
    pending = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        pending += batch.num_rows
        table = pa.Table.from_batches(held)
        ids = [table.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        if not len(new):
            continue
        edges = np.concatenate(([0], new))
        cost = np.cumsum(np.diff(edges).astype(np.int64) ** 2)
        begin, spent = 0, 0
        for k, c in enumerate(cost):
            if c - spent >= weight or k == len(cost) - 1:
                yield table.slice(edges[begin], edges[k + 1] - edges[begin])
                begin, spent = k + 1, c
        rest = table.slice(new[-1])
        held, pending = rest.combine_chunks().to_batches(), rest.num_rows
    if pending:
        yield pa.Table.from_batches(held)


def _group_ids(table: pa.Table, keys: int) -> np.ndarray:
    ids = [table.column(k).to_numpy() for k in range(keys)]
    new = np.zeros(table.num_rows, np.int64)
    new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
    return np.cumsum(new)


def _spanned(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n points reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _keys(reps: DataFrame, p: MinHash) -> DataFrame:
    """(key, rep) for every chunk and every choice of ``errors`` of its symbols left out."""
    kept = [c for c in combinations(range(p.symbols), p.symbols - p.errors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, p.length).astype(np.uint64)
            for c in range(p.chunks):
                chunk = sig[:, c * p.symbols : (c + 1) * p.symbols]
                for m, places in enumerate(kept):
                    h = np.full(len(ids), c * len(kept) + m + 1, np.uint64)
                    for s in places:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + chunk[:, s])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0)], names=["key", "rep"])

    return reps.select("rep", "signature").mapInArrow(run, "key long, rep long")


def _near(units: DataFrame, p: MinHash) -> DataFrame:
    """Spanning edges (a, b) of the pairs of every unit that lie within the signature distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _rows(batches, 3, 1 << 22):
            group = _group_ids(table, 3)
            cross = (table.column(1).to_numpy() != table.column(2).to_numpy())
            block, rep, size = (table.column(k).to_numpy() for k in (3, 4, 5))
            sig = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint16).reshape(-1, p.length)
            lefts, rights = [], []
            active = np.arange(table.num_rows)
            lag = 0
            while len(active):
                lag += 1
                active = active[active + lag < table.num_rows]
                active = active[group[active] == group[active + lag]]
                a, b = active, active + lag
                fits = np.minimum(size[a], size[b]) * 100 >= p.percent * np.maximum(size[a], size[b])
                fits &= ~cross[a] | (block[a] != block[b])
                a, b = a[fits], b[fits]
                close = (sig[a] != sig[b]).sum(axis=1) <= p.distance
                lefts.append(a[close])
                rights.append(b[close])
            a, b = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (lefts, rights))
            label = _spanned(table.num_rows, a, b)
            moved = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], names=["a", "b"])

    order = ["key", "left", "right"]
    rows = units.select(*order, "block", "rep", "n_shingles", "signature")
    # by rep inside a unit, so that every forest hangs from its smallest one
    return rows.repartition(*order).sortWithinPartitions(*order, "rep").mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of distinct-value arrays."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    everywhere = (counts == len(sets)).sum()
    useful = (counts > 1) & (counts < len(sets))
    place = np.cumsum(useful) - 1
    chosen = useful[column]
    row, column = row[chosen], place[column[chosen]]
    out = np.full((len(sets), len(sets)), everywhere, np.int64)
    width = 4096
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(useful.sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += (part @ part.T).astype(np.int64)
    # a value of one set only meets itself
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _confirmed(units: DataFrame, p: MinHash) -> DataFrame:
    """Spanning links (a, b) of the pairs of every unit whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _rows(batches, 3, 1):
            block, rep = (table.column(k).to_numpy() for k in (3, 4))
            sets = [np.frombuffer(x, np.uint64) for x in table.column(5).to_pylist()]
            size = np.array([len(s) for s in sets])
            common = overlaps(sets)
            linked = 100 * common >= p.percent * (size[:, None] + size[None, :] - common)
            if table.column(1)[0].as_py() != table.column(2)[0].as_py():
                linked &= block[:, None] != block[None, :]
            a, b = np.nonzero(np.triu(linked, 1))
            label = _spanned(len(sets), a, b)
            moved = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], names=["a", "b"])

    order = ["family", "left", "right"]
    rows = units.select(*order, "block", "rep", "shingles")
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, p: MinHash) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch.column(2)):
                sets, of = distinct(*shingles(words(part, fold=True), p.shingle))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(part.first, len(part)) for k in (0, 1)), as_binary(sets, of)],
                    names=["family", "rep", "shingles"],
                )

    return docs.mapInArrow(run, "family long, rep long, shingles binary")


def near_duplicates(docs: DataFrame, p: MinHash = MinHash(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    A-Z count as a-z. A text with fewer words than a shingle is one shingle; a null, empty or blank text has
    none and is linked with nothing. Documents with equal sets are always linked. component_id is the
    smallest doc_id reached over links. Rows that repeat a doc_id are linked by their texts; if two texts
    share a doc_id, the id joins their components. A null doc_id gets a null component and kept true.
    Ids that are no whole numbers are compared as they sort. Other columns of ``docs`` are ignored; an empty table
    gives an empty result; a long text is read whole, in a slice of its own.
    """
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        return _by_number(docs, p, doc_id, text)
    signed = keep(signatures(docs, p, doc_id, text))
    known = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n_shingles"]
    reps = keep(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    units = in_blocks(_keys(reps, p), ["key"], "rep", p.bucket_block).join(
        reps.select("rep", "n_shingles", "signature"), "rep"
    )
    families = settled(docs.sparkSession, lambda: components(_near(units, p).distinct()))
    roots = families.select("root").distinct().select("root", F.col("root").alias("node"))
    members = families.unionByName(roots)
    wanted = members.select(F.col("node").alias("rep"), F.col("root").alias("family"))
    source = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    wanted = keep(wanted)
    if wanted.count() <= p.most_broadcast:
        wanted = F.broadcast(wanted)
    full = _sets(source.join(wanted, "rep").select("family", "rep", "text"), p)
    links = _confirmed(in_blocks(keep(full), ["family"], "rep", p.family_block), p)
    alias = known.join(reps.select(*same, "rep"), same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = alias.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high")
    extra = alias.join(repeated.select("a", "low"), "a").where("low <> b").select(F.col("low").alias("a"), "b")
    found = settled(docs.sparkSession, lambda: components(links.unionByName(extra)))
    ids = signed.join(reps.select(*same, "rep"), same, "left").join(
        found.select(F.col("node").alias("rep"), F.col("root")), "rep", "left"
    )
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    return ids.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _by_number(docs: DataFrame, p: MinHash, doc_id: str, text: str) -> DataFrame:
    """``near_duplicates`` of texts with other ids, by each id's place in their order."""
    ids = docs.select(docs[doc_id].alias("id")).where("id is not null").distinct()
    places = keep(ids.orderBy("id").withColumn("place", F.monotonically_increasing_id()))
    named = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).join(places, "id", "left")
    found = near_duplicates(named.select("place", "text"), p, "place", "text")
    first = places.select(F.col("place").alias("component_id"), F.col("id").alias("component"))
    own = places.select(F.col("place").alias("doc_id"), "id")
    return found.join(first, "component_id", "left").join(own, "doc_id", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept"
    )
