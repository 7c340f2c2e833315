"""A hierarchical Pitman-Yor language model of word contexts, seated by Gibbs sampling.

Every context is a restaurant; a context is the previous word, or the beginning of a text, so contexts grow with
the vocabulary. All contexts share one parent, the restaurant of single words, which rests on the uniform
distribution. A context's tables are the parent's customers.

The state is dealt by words into buckets: a sweep empties one word's customers out of every restaurant and seats
them again one by one, given the restaurants' totals of the sweep before. After a sweep every bucket sends the tables
of its contexts to the contexts' own buckets, which add them up and answer in the same order: totals are a table of
Spark's, never an array of the driver's. Pairs of the most frequent words are dealt by their contexts too, and
only these few words' sums pass the driver. Large counts are seated in steps of a sixteenth of those that sit.
Sweeps draw from generators seeded by place and sweep, so any task can be run again, and a sweep is rebuilt from the
counts and the totals instead of being stored. Predictive probabilities are averaged over the samples kept.

Texts are dealt into blocks of bounded size. A block asks for its distinct (context, word) pairs, the model
answers in the same order, and the block scores its texts; neither texts nor vocabulary pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.store import keep, key_hash, settled
from pathpulse.llm.words import Text, mix, texts, words

#: Hashes that stand for the end of a text and, as a context, for its beginning, which sorts behind all words.
END = np.uint64(0xE2D0F7E37)
BEGIN = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class PitmanYor:
    """``sweeps`` of Gibbs sampling, of which the last ``samples`` are averaged; strengths are fixed.

    A word's seating in a restaurant is one of ``draws`` proposals, kept in proportion to its weight.
    Discounts are estimated from the counts of once and twice seen pairs (n1 / (n1 + 2 n2)).
    ``block_bytes`` bounds the text that one task scores at a time. Words that fill an eighth of a bucket or more in some
    ``sample_bytes`` of text, the ``hot_words`` most frequent of them, have their pairs dealt by context as well; that
    decides where pairs lie, not how they count.
    """

    hot_words: int = 2048
    sample_bytes: int = 16 << 20
    sweeps: int = 4
    samples: int = 2
    draws: int = 4
    strength: float = 1.0
    block_bytes: int = 16 << 20
    seed: int = 9


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and the place of each value among them."""
    codes, found = pd.factorize(x)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[codes]


def _packets(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, learned, sizes, data): the texts of a task that fall into a block, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held)
            held.clear()
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            table, block = table.take(pa.array(order)), block[order]
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            rows = [[], [], [], [], []]
            for a, b in zip(edges, np.append(edges[1:], len(block))):
                part = table.slice(a, b - a)
                data = [x or b"" for x in part.column("text").to_pylist()]
                for row, x in zip(
                    rows,
                    (block[a], part.column("doc_id").to_pylist(), part.column("learned").to_pylist(), [len(x) for x in data], squeeze.compress(b"".join(data))),
                ):
                    row.append(x)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(rows, (pa.int32(), pa.list_(ids), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()))],
                names=["block", "ids", "learned", "sizes", "data"],
            )

        size = 0
        for batch in batches:
            ids = batch.column(0).type
            held.append(batch)
            size += batch.nbytes
            if size > 16 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "learned", F.col("text").cast("binary").alias("text"), "block").mapInArrow(
        run, f"block int, ids array<{kind}>, learned array<boolean>, sizes array<long>, data binary"
    )


@dataclass
class Deal:
    """Where pairs lie: 2 ** bits buckets by word, or by word and context for the words in ``hot`` (ascending)."""

    hot: np.ndarray
    bits: int

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in ``hot``, or -1."""
        if not len(self.hot):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)
        return np.where(self.hot[at] == hashes, at, -1)

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def keys(self, contexts: np.ndarray) -> np.ndarray:
        """A context's bucket and the next 32 bits of its hash."""
        return contexts >> np.uint64(32 - self.bits)

    def packed(self, keys: np.ndarray) -> tuple[bytes, bytes]:
        """Ascending keys as where each bucket's begin, and 32 bits of each."""
        edges = np.searchsorted(keys >> np.uint64(32), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        return edges.astype(np.uint32).tobytes(), keys.astype(np.uint32).tobytes()

    def unpacked(self, edges: bytes, keys: bytes) -> np.ndarray:
        part = np.repeat(np.arange(1 << self.bits, dtype=np.uint64), np.diff(np.frombuffer(edges, np.uint32)))
        return (part << np.uint64(32)) | np.frombuffer(keys, np.uint32)


@dataclass
class Block:
    """Tokens of a block: its pairs by (bucket, word, context) and the pair of every token.

    ``group`` numbers the (bucket, word) of a pair; ``contexts`` are the hashes that ``pair_context`` points to.
    """

    ids: list
    learned: np.ndarray
    of: np.ndarray
    contexts: np.ndarray
    group_word: np.ndarray
    group_bucket: np.ndarray
    group: np.ndarray
    pair_context: np.ndarray
    token_pair: np.ndarray


def _read(packets: pa.Table, deal: Deal) -> Block:
    open_ = zstandard.ZstdDecompressor()
    ids, learned, hashes, sizes = [], [], [], []
    for k in range(packets.num_rows):
        lengths = np.array(packets.column("sizes")[k].as_py(), np.int64)
        data = np.frombuffer(open_.decompress(packets.column("data")[k].as_py()), np.uint8) if lengths.any() else np.zeros(0, np.uint8)
        ids += packets.column("ids")[k].as_py()
        learned += packets.column("learned")[k].as_py()
        at = np.concatenate(([0], np.cumsum(lengths)))
        column = pa.Array.from_buffers(pa.large_utf8(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(data)])
        for part in texts(column):
            h, n = _tokens(part)
            hashes.append(h)
            sizes.append(n)
    hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
    of = np.concatenate(([0], np.cumsum(sizes)))
    distinct, word = _unique(hashes)
    before = np.concatenate(([0], word[:-1]))
    before[of[:-1]] = len(distinct)
    pairs, token_pair = _unique(word * (len(distinct) + 1) + before)
    pair_word, pair_context = np.divmod(pairs, len(distinct) + 1)
    contexts = np.append(distinct, BEGIN)
    bucket = deal.bucket(distinct)[pair_word]
    split = np.flatnonzero(deal.place(distinct)[pair_word] >= 0)
    bucket[split] = deal.bucket(mix(distinct[pair_word[split]] ^ mix(contexts[pair_context[split]])))
    order = np.argsort(bucket, kind="stable")
    spot = np.empty(len(order), np.int64)
    spot[order] = np.arange(len(order))
    bucket, pair_word = bucket[order], pair_word[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (pair_word[1:] != pair_word[:-1]))
    return Block(
        ids, np.array(learned, bool), of, contexts, distinct[pair_word[new]], bucket[new], np.cumsum(new) - 1,
        pair_context[order], spot[token_pair],
    )


def _tokens(part: Text) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts with their ends, and tokens per text."""
    w = words(part, fold=True)
    return np.insert(w.hashes, w.of[1:], END), np.diff(w.of) + 1


def _hot_words(source: DataFrame, size: int, bits: int, p: PitmanYor) -> np.ndarray:
    """Hashes of the words that fill an eighth of a bucket in a part of the texts of bounded size, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch.column(0)):
                found, n = np.unique(_tokens(part)[0], return_counts=True)
                # the row without a hash counts all
                rows = [pa.array([None, *found.view(np.int64).tolist()], pa.int64()), pa.array([n.sum(), *n.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=["hash", "n"])

    part = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 + size // p.sample_bytes)) == 0).select("text")
    counts = part.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "hash").limit(p.hot_words + 1).collect()
    every = max((r.n for r in rows), default=0)
    return np.sort(np.array([r.hash for r in rows if r.hash is not None and r.n << (bits + 3) >= every], np.int64).view(np.uint64))


def _requests(packets: DataFrame, deal: Deal) -> DataFrame:
    """Per block and bucket: the words, their pairs, the pairs' contexts, and their counts in learned texts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = _read(table, deal)
        seen = np.repeat(b.learned, np.diff(b.of))
        counts = np.bincount(b.token_pair[seen], minlength=len(b.group)).astype(np.uint32)
        edges = np.searchsorted(b.group_bucket, np.arange((1 << deal.bits) + 1))
        pair_edges = np.searchsorted(b.group, edges)
        rows = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            w, e = slice(edges[k], edges[k + 1]), slice(pair_edges[k], pair_edges[k + 1])
            pairs = np.bincount(b.group[e] - edges[k], minlength=edges[k + 1] - edges[k])
            used, context = _unique(b.pair_context[e])
            rows.append((
                k, key[0].as_py(), b.group_word[w].tobytes(), _narrow(pairs), *deal.packed(deal.keys(b.contexts[used])),
                _narrow(context, np.uint16), _narrow(counts[e]), len(context),
            ))
        columns = list(zip(*rows)) or [[]] * 9
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["bucket", "block", "words", "pairs", "edges", "keys", "contexts", "counts", "n"]
    return packets.groupBy("block").applyInArrow(
        run,
        "bucket int, block int, words binary, pairs binary, edges binary, keys binary, contexts binary, counts binary, n long",
    )


def _narrow(counts: np.ndarray, kind: type = np.uint8) -> bytes:
    """Counts in one byte each (or ``kind``); its largest value stands for the next of the four-byte counts at the end."""
    most = np.iinfo(kind).max
    return np.minimum(counts, most).astype(kind).tobytes() + counts[counts >= most].astype(np.uint32).tobytes()


def _wide(data: bytes, n: int, kind: type = np.uint8) -> np.ndarray:
    out = np.frombuffer(data, kind, n).astype(np.int64)
    out[out == np.iinfo(kind).max] = np.frombuffer(data, np.uint32, offset=n * np.dtype(kind).itemsize)
    return out


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as steps, which are short."""
    return _narrow(np.diff(places, prepend=0))


def _places(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_wide(data, n))


def _merged(requests: DataFrame, deal: Deal) -> DataFrame:
    """Per bucket: its contexts, counts of all its pairs, statistics, and for each block where its pairs and words lie.

    ``facts``: counts of the hot words, their contexts, then tokens, other words, pairs seen once and twice, and other
    words with one and two contexts.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        asks = table.to_pylist()
        blocks, hashes = [x["block"] for x in asks], [np.frombuffer(x["words"], np.uint64) for x in asks]
        pairs = [_wide(x["pairs"], len(h)) for x, h in zip(asks, hashes)]
        keys = [deal.unpacked(x["edges"], x["keys"]) for x in asks]
        contexts = [_wide(x["contexts"], x["n"], np.uint16) for x in asks]
        asked_counts = [_wide(x["counts"], x["n"]) for x in asks]
        every, word = _unique(np.concatenate(hashes))
        own, key_at = _unique(np.concatenate(keys))
        first = np.cumsum([0, *map(len, keys)])
        context = key_at[np.concatenate([c + f for c, f in zip(contexts, first)])]
        pair_word = np.repeat(word, np.concatenate(pairs))
        codes, pair = _unique(pair_word * len(own) + context)
        counts = np.bincount(pair, np.concatenate(asked_counts), len(codes)).astype(np.int64)
        of_word, of_context = np.divmod(codes, len(own))
        per_word = np.bincount(of_word, counts, len(every)).astype(np.int64)
        kinds = np.bincount(of_word, counts > 0, len(every)).astype(np.int64)
        place = deal.place(every)
        hot, cold = place >= 0, place < 0
        sums = np.zeros((2, len(deal.hot)), np.int64)
        sums[:, place[hot]] = per_word[hot], kinds[hot]
        facts = [
            per_word.sum(), (per_word[cold] > 0).sum(), *((counts == n).sum() for n in (1, 2)), *((kinds[cold] == n).sum() for n in (1, 2))
        ]
        word_at, pair_at = (np.cumsum([0, *map(len, x)]) for x in (hashes, contexts))
        asked = [
            {"block": x, "n_words": int(b - a), "n_pairs": int(d - c), "words": _steps(word[a:b]), "pairs": _steps(pair[c:d])}
            for x, a, b, c, d in zip(blocks, word_at[:-1], word_at[1:], pair_at[:-1], pair_at[1:])
        ]
        edges, low = deal.packed(own)
        row = {
            "bucket": key[0].as_py(),
            "hot": place.astype(np.int32).tobytes(),
            "per_word": np.bincount(of_word, minlength=len(every)).astype(np.uint32).tobytes(),
            "edges": edges,
            "keys": low,
            "contexts": of_context.astype(np.uint32).tobytes(),
            "counts": _narrow(counts),
            "facts": [*sums.ravel().tolist(), *map(int, facts)],
            "asked": asked,
        }
        return pa.Table.from_pylist([row], schema)

    binaries = ["hot", "per_word", "edges", "keys", "contexts", "counts"]
    ask = pa.struct([("block", pa.int32()), ("n_words", pa.int64()), ("n_pairs", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])
    schema = pa.schema(
        [("bucket", pa.int32()), *((x, pa.binary()) for x in binaries), ("facts", pa.list_(pa.int64())), ("asked", pa.list_(ask))]
    )
    return requests.groupBy("bucket").applyInArrow(
        run,
        f"bucket int, {', '.join(f'{x} binary' for x in binaries)}, facts array<long>, "
        "asked array<struct<block:int,n_words:long,n_pairs:long,words:binary,pairs:binary>>",
    )


def _totals(rows: DataFrame, column: str) -> np.ndarray:
    """Sums of a fixed-length array column by position."""
    found = rows.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    return np.array([r.n for r in sorted(found)], np.int64)


def _sit(
    c: np.ndarray, new: np.ndarray, per_table: np.ndarray, discount: float, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes of two and more customers (falling), and the log of the weights that their customers chose from."""
    tables, weights = np.ones(len(c)), np.zeros(len(c))
    k = 1
    while True:
        n = int(np.searchsorted(-c, -k, "left"))
        if not n:
            return tables, weights
        t = tables[:n]
        opened = new[:n] + per_table[:n] * t
        every = opened + k - discount * t
        step = max(1, k // 16)
        if step == 1:
            weights[:n] += np.log(every)
            t += rng.random(n) < opened / every
        else:
            steps = np.minimum(step, c[:n] - k).astype(np.int64)
            weights[:n] += steps * np.log(every)
            t += rng.binomial(steps, np.minimum(opened / every, 1))
        k += step


def seat(
    customers: np.ndarray, new: np.ndarray, per_table: np.ndarray, discount: float, rng: np.random.Generator, draws: int = 1
) -> np.ndarray:
    """Tables of one dish when its ``customers`` sit down one after the other in an emptied section.

    With k seated at t tables, a customer opens a table with weight new + per_table * t and joins one with
    weight k - discount * t. Customers that come after 16 others are seated in steps of k / 16. One draw follows the
    customers' own choices. Given that they all chose this dish, a seating is likelier by the product of the weights
    that they chose from: of several ``draws`` one is kept in proportion to it.
    """
    out = (customers > 0).astype(np.int64)
    many = np.flatnonzero(customers > 1)
    order = many[np.argsort(-customers[many], kind="stable")]
    c, new, per_table = customers[order], new[order], per_table[order]
    tables, weights = _sit(c, new, per_table, discount, rng)
    # two customers choose once, from the same weight in every draw: their first draw is exact
    deep = int(np.searchsorted(-c, -2, "left"))
    weights = weights[:deep]
    for _ in range(draws - 1):
        other, weight = _sit(c[:deep], new[:deep], per_table[:deep], discount, rng)
        both = np.logaddexp(weights, weight)
        tables[:deep] = np.where(rng.random(deep) < np.exp(weight - both), other, tables[:deep])
        weights = both
    out[order] = tables
    return out


@dataclass
class Parent:
    """The parent restaurant after a sweep: customers and tables in all, and those of the hot words."""

    customers: int
    tables: int
    hot_customers: np.ndarray
    hot_tables: np.ndarray


@dataclass
class Model:
    """What all tasks share: discounts, vocabulary, and the parent after every sweep."""

    p: PitmanYor
    vocabulary: int
    discount: float
    parent_discount: float
    history: list[Parent]
    hot_counts: np.ndarray

    @property
    def base(self) -> float:
        return 1 / (self.vocabulary + 1)

    def above(self, customers: np.ndarray, tables: np.ndarray, parent: Parent) -> np.ndarray:
        """Probability of words in the parent restaurant."""
        back = (self.p.strength + self.parent_discount * parent.tables) * self.base
        return (customers - self.parent_discount * tables + back) / (self.p.strength + parent.customers)

    def seat_words(self, customers: np.ndarray, tables: np.ndarray, parent: Parent, rng: np.random.Generator) -> np.ndarray:
        """Tables of words in the parent when their ``customers`` sit down again."""
        new = (self.p.strength + self.parent_discount * (parent.tables - tables)) * self.base
        return seat(customers, new, np.full(len(new), self.parent_discount * self.base), self.parent_discount, rng, self.p.draws)

    def after(self, totals: np.ndarray) -> Parent:
        """The parent from the hot words' customers and the other words' customers and tables."""
        hot = totals[:-2]
        if not self.history:
            tables = (hot > 0).astype(np.int64)
        else:
            last = self.history[-1]
            rng = np.random.default_rng([self.p.seed, len(self.history), 1 << 31])
            tables = self.seat_words(hot, last.hot_tables, last, rng)
        return Parent(int(totals[-2] + hot.sum()), int(totals[-1] + tables.sum()), hot, tables)


@dataclass
class State:
    """A bucket after a sweep: tables of its pairs, customers and tables of its words in the parent."""

    tables: np.ndarray
    customers: np.ndarray
    sat: np.ndarray


class Bucket:
    """Pairs of a bucket, from its row, with what the contexts' buckets answered (``totals`` rows) after each sweep."""

    def __init__(self, row: dict, totals: pa.Table | None = None):
        self.number = row["bucket"]
        self.hot = np.frombuffer(row["hot"], np.int32)
        self.word = np.repeat(np.arange(len(self.hot)), np.frombuffer(row["per_word"], np.uint32).astype(np.int64))
        self.context = np.frombuffer(row["contexts"], np.uint32).astype(np.int64)
        self.counts = _wide(row["counts"], len(self.context))
        self.edges = np.frombuffer(row["edges"], np.uint32).astype(np.int64)
        self.contexts = int(self.edges[-1])
        self.in_context = np.zeros(self.contexts, np.int64)
        self.rounds: list[np.ndarray] = []
        for r in totals.to_pylist() if totals is not None else []:
            place = slice(self.edges[r["part"]], self.edges[r["part"] + 1])
            while len(self.rounds) <= r["round"]:
                self.rounds.append(np.zeros(self.contexts, np.int64))
            self.rounds[r["round"]][place] = _wide(r["tables"], place.stop - place.start)
            if r["counts"]:
                self.in_context[place] = _wide(r["counts"], place.stop - place.start)

    def start(self) -> State:
        tables = (self.counts > 0).astype(np.int64)
        customers = np.bincount(self.word, tables, len(self.hot)).astype(np.int64)
        return State(tables, customers, (customers > 0).astype(np.int64))

    def with_hot(self, state: State, parent: Parent) -> State:
        """``state`` with the hot words' customers and tables of all buckets."""
        hot = self.hot >= 0
        customers, sat = state.customers.copy(), state.sat.copy()
        customers[hot], sat[hot] = parent.hot_customers[self.hot[hot]], parent.hot_tables[self.hot[hot]]
        return State(state.tables, customers, sat)

    def sweeps(self, model: Model) -> Iterator[State]:
        """States after every sweep that the totals known so far allow."""
        p, state = model.p, self.start()
        for s in range(min(p.sweeps, len(model.history))):
            parent, state = model.history[s], self.with_hot(state, model.history[s])
            rng = np.random.default_rng([p.seed, s, self.number])
            above = model.above(state.customers, state.sat, parent)[self.word]
            rest = self.rounds[s][self.context] - state.tables
            tables = seat(self.counts, (p.strength + model.discount * rest) * above, model.discount * above, model.discount, rng, p.draws)
            customers = np.bincount(self.word, tables, len(self.hot)).astype(np.int64)
            cold = self.hot < 0
            sat = np.zeros(len(self.hot), np.int64)
            sat[cold] = model.seat_words(customers[cold], state.sat[cold], parent, rng)
            state = State(tables, customers, sat)
            yield state


def _sent(bucket: Bucket, keys: np.ndarray, state: State, hot_words: int, counts: bool) -> pa.Table:
    """One row for every bucket of contexts with the tables there, and one of sums for the driver (part -1)."""
    tables = np.bincount(bucket.context, state.tables, bucket.contexts).astype(np.int64)
    customers = np.bincount(bucket.context, bucket.counts, bucket.contexts).astype(np.int64)
    parts = np.flatnonzero(np.diff(bucket.edges))
    cut = [slice(bucket.edges[k], bucket.edges[k + 1]) for k in parts]
    hot, cold = bucket.hot >= 0, bucket.hot < 0
    sums = np.zeros(hot_words, np.int64)
    sums[bucket.hot[hot]] = state.customers[hot]
    sums = [*sums.tolist(), int(state.customers[cold].sum()), int(state.sat[cold].sum())]
    return pa.Table.from_arrays(
        [
            pa.array([*parts.tolist(), -1], pa.int32()), pa.array([bucket.number] * (len(parts) + 1), pa.int32()),
            pa.array([*(keys[c].tobytes() for c in cut), b""], pa.binary()),
            pa.array([*(_narrow(tables[c]) for c in cut), b""], pa.binary()),
            pa.array([*(_narrow(customers[c]) if counts else b"" for c in cut), b""], pa.binary()),
            pa.array([*([[]] * len(parts)), sums], pa.list_(pa.int64())),
        ],
        names=["part", "bucket", "keys", "tables", "counts", "sums"],
    )


_SENT = "part int, bucket int, keys binary, tables binary, counts binary, sums array<long>"
_STATE = ["bucket", "hot", "per_word", "edges", "contexts", "counts"]


def _first(rows: DataFrame, hot_words: int) -> DataFrame:
    """What the buckets send of the first state: one table for every pair and every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket = Bucket(row)
                yield from _sent(bucket, np.frombuffer(row["keys"], np.uint32), bucket.start(), hot_words, True).to_batches()

    return rows.select(*_STATE, "keys").mapInArrow(run, _SENT)


def _sweep(rows: DataFrame, totals: DataFrame, model: Model) -> DataFrame:
    """What the buckets send after the next sweep."""

    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        bucket = Bucket(row, found)
        for state in bucket.sweeps(model):
            pass
        return _sent(bucket, np.frombuffer(row["keys"], np.uint32), state, len(model.history[0].hot_tables), False)

    return rows.select(*_STATE, "keys").groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(run, _SENT)


def _added(sent: DataFrame, number: int) -> DataFrame:
    """Per bucket and bucket of contexts: totals of the contexts, in the order in which they were sent."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        at = np.cumsum([0, *map(len, keys)])
        every, place = _unique(np.concatenate(keys))
        out = []
        for name in ("tables", "counts"):
            data = table.column(name).to_pylist()
            if not any(data):
                out.append([b""] * len(data))
                continue
            sums = np.bincount(place, np.concatenate([_wide(x, len(k)) for x, k in zip(data, keys)]), len(every)).astype(np.int64)
            out.append([_narrow(sums[place[a:b]]) for a, b in zip(at[:-1], at[1:])])
        n = table.num_rows
        return pa.Table.from_arrays(
            [
                table.column("bucket").combine_chunks(), pa.array([number] * n, pa.int32()), table.column("part").combine_chunks(),
                *(pa.array(x, pa.binary()) for x in out),
            ],
            names=["bucket", "round", "part", "tables", "counts"],
        )

    return sent.where("part >= 0").groupBy("part").applyInArrow(
        run, "bucket int, round int, part int, tables binary, counts binary"
    )


def _answers(rows: DataFrame, totals: DataFrame, model: Model) -> DataFrame:
    """Per block and bucket: counts of the block's words and log10 probabilities of its pairs."""
    p = model.p

    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        bucket = Bucket(row, found)
        chance = 0.0
        for s, state in enumerate(bucket.sweeps(model)):
            if s < p.sweeps - p.samples:
                continue
            parent = model.history[s + 1]
            state = bucket.with_hot(state, parent)
            above = model.above(state.customers, state.sat, parent)[bucket.word]
            back = (p.strength + model.discount * bucket.rounds[s + 1][bucket.context]) * above
            chance = chance + (bucket.counts - model.discount * state.tables + back) / (p.strength + bucket.in_context[bucket.context])
        logs = np.log10(chance / p.samples).astype(np.float32)
        known = np.bincount(bucket.word, bucket.counts, len(bucket.hot)).astype(np.uint64)
        hot = bucket.hot >= 0
        known[hot] = model.hot_counts[bucket.hot[hot]]
        asked = row["asked"]
        return pa.Table.from_arrays(
            [
                pa.array([x["block"] for x in asked], pa.int32()),
                pa.array([bucket.number] * len(asked), pa.int32()),
                pa.array([known[_places(x["words"], x["n_words"])].tobytes() for x in asked], pa.binary()),
                pa.array([logs[_places(x["pairs"], x["n_pairs"])].tobytes() for x in asked], pa.binary()),
            ],
            names=["block", "bucket", "known", "logs"],
        )

    return rows.select(*_STATE, "asked").groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(
        run, "block int, bucket int, known binary, logs binary"
    )


def language_scores(
    docs: DataFrame, p: PitmanYor = PitmanYor(), modulus: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Scores of all texts under the model and under the smoothed word counts.

    Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity
    (10 ** (-score / n_tokens)). Texts whose crc32(doc_id as text) leaves 0 by ``modulus`` are not learned
    from; neither are rows without id, which count as held out. A null, empty or blank text is its end alone.
    A very long text is one block of its own. Repeated rows are learned from and scored each; other columns are
    ignored; an empty table gives an empty result. Without any learned text all words have the base probability.
    Words equal in their 64-bit hashes are one word; contexts equal in their bucket and 32 bits more, one in some
    100,000, share a restaurant. Words of equal counts at the edge of the hot ones are taken by hash.
    """
    held = F.coalesce(key_hash(doc_id) % modulus == 0, F.lit(True))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (~held).alias("learned"))
    return settled(docs.sparkSession, lambda: _scores(source, p))


def _scores(source: DataFrame, p: PitmanYor) -> DataFrame:
    spark = source.sparkSession
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // p.block_bytes
    bits = min(20, int(blocks - 1).bit_length())
    deal = Deal(_hot_words(source, size, bits, p), bits)
    source = source.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    packets = _packets(source, blocks)
    rows = settled(spark, lambda: _merged(_requests(packets, deal), deal))
    facts, hot_words = _totals(rows, "facts"), len(deal.hot)
    if not len(facts):
        facts = np.zeros(2 * hot_words + 6, np.int64)
    hot_counts, hot_kinds = facts[:hot_words], facts[hot_words : 2 * hot_words]
    tokens, vocabulary, once, twice, single, double = (int(x) for x in facts[2 * hot_words :])
    vocabulary += int((hot_counts > 0).sum())
    single, double = single + int((hot_kinds == 1).sum()), double + int((hot_kinds == 2).sum())
    discounts = (min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in ((once, twice), (single, double)))
    model = Model(p, vocabulary, *discounts, [], hot_counts)
    totals = None

    def exchanged() -> DataFrame:
        number = len(model.history)
        sent = keep(_sweep(rows, totals, model) if number else _first(rows, hot_words))
        sums = _totals(sent.where("part < 0"), "sums")
        model.history.append(model.after(sums if len(sums) else np.zeros(hot_words + 2, np.int64)))
        return _added(sent, number)

    for _ in range(p.sweeps + 1):
        found = settled(spark, exchanged)
        totals = found if totals is None else totals.unionByName(found)
    answers = _answers(rows, totals, model)
    below = tokens + 0.1 * (vocabulary + 1)

    def score(key: tuple, texts_: pa.Table, found: pa.Table) -> pa.Table:
        b = _read(texts_, deal)
        order = np.argsort(found.column("bucket").to_numpy())
        joined = [b"".join(found.column(c)[int(k)].as_py() for k in order) for c in ("known", "logs")]
        known, logs = np.frombuffer(joined[0], np.uint64).astype(float), np.frombuffer(joined[1], np.float32).astype(float)
        base = np.log10((known + 0.1) / below)
        word = b.group[b.token_pair]
        sums = [np.add.reduceat(x, b.of[:-1]) for x in (base[word], logs[b.token_pair], (known > 0).astype(np.int64)[word])]
        n = np.diff(b.of)
        return pa.Table.from_arrays(
            [
                pa.array(b.ids, id_type), pa.array(~b.learned), pa.array(n), pa.array(sums[2]),
                pa.array(np.full(len(n), tokens)), pa.array(sums[0]), pa.array(sums[1]), pa.array(10 ** (-sums[1] / n)),
            ],
            names=names,
        )

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kind = source.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    return packets.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, perplexity double",
    )
