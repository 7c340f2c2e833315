"""Personal data in texts: exact patterns, and a skip-chain conditional random field that adds to them.

The field's nodes are the patterns' own finds and other candidates: number runs, and mail addresses that are
written with ``(at)`` and ``(dot)``. A node's potential is a multinomial logistic model of its shape. Neighbouring nodes
are joined by chain edges; nodes that repeat or resemble one another (the same address, or the same last
digits) are joined by skip edges, however far apart: all to the first find among them, or, without a find, each
to the one before it. Loopy sum-product messages over all edges, until they change no more, make the labels of a
document agree, and a candidate whose marginal is high enough is added.

All potentials are learned piecewise from all texts: the logistic model from counts of shapes and labels, the edges'
from counts of label pairs. Finds count under their labels and candidates that resemble no find as none;
candidates that resemble one are unlabelled, and neither they nor their edges are counted, so that however often a text
repeats a find unmarked, it doesn't teach that such places are none. Both tables are bounded by the number of shapes
and labels.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.words import texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_AT, _DOT = r"\x20?[\[({](?:at|@)[\])}]\x20?", r"(?:\.|\x20?[\[({](?:dot|\.)[\])}]\x20?)"
_VEILED = re.compile(rf"{_AT}([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")
_FLAGS = np.isin(np.arange(256), np.frombuffer(b"0123456789@", np.uint8))
_VEILS = re.compile(rb"[\[({](?:at|@)[\])}]", re.IGNORECASE)

Span = tuple[str, int, int]


@dataclass(frozen=True)
class SkipChain:
    """Change at which messages have settled (and the rounds after which they are left as they are, if they swing),
    their damping, the marginal that adds a span, and the pairs counted before any is seen."""

    tolerance: float = 1e-5
    rounds: int = 2000
    damping: float = 0.3
    least: float = 0.9
    same: float = 20.0
    other: float = 0.5
    penalty: float = 0.1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _local_start(text: str, at: int, low: int) -> int:
    while at > low and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[Span]:
    """Finds of the exact patterns, by kind and then by place.

    Equal to a left-to-right search for each pattern, in time linear in the text: an address is looked for at its
    sign, and four number parts are taken from a whole dotted run.
    """
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, end)
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for run in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, *run.span()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", four[0].start(), four[3].end()))
    for match in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", match.group()) if match.end() - match.start() <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *match.span()))
    for match in _PHONE.finditer(text):
        if 8 <= sum(len(x) for x in _DIGITS.findall(match.group())) <= 15:
            out.append(("phone", *match.span()))
    return out


def _candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Other places that may hold personal data and overlap nothing found."""
    found = []
    for match in _VEILED.finditer(text):
        start = _local_start(text, match.start(), 0)
        if start < match.start():
            found.append((start, match.end()))
    for match in _NUMBER.finditer(text):
        if sum(len(x) for x in _DIGITS.findall(match.group())) >= 7:
            found.append(match.span())
    busy = sorted((a, b) for _, a, b in taken)
    out, k, last = [], 0, 0
    for a, b in sorted(found):
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        if a >= last and (k == len(busy) or busy[k][0] >= b):
            out.append((a, b))
            last = b
    return out


def _plain(found: str) -> str:
    """The find with veiled signs written out, in small letters."""
    return re.sub(_DOT, ".", re.sub(_AT, "@", found, flags=re.IGNORECASE), flags=re.IGNORECASE).lower()


def shape(found: str) -> str:
    """Bounded description of a node: 25,600 values at most. The leading + doesn't count."""
    plain = _plain(found)
    if "@" in plain:
        return "email"
    groups = _DIGITS.findall(plain)
    digits = "".join(groups)
    size = sum(len(digits) >= n for n in (7, 8, 10, 12, 14, 16, 20))
    signs = "".join(str(int(c in plain)) for c in " .-(")
    card = int(16 <= len(digits) <= 19 and luhn(digits))
    ip = int(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain) is not None and all(int(g) <= 255 for g in groups))
    return f"{size} {signs} {card}{ip} {min(len(groups), 5)} {min(len(groups[-1]), 5)}"


def _fits(kind: str, found: str) -> bool:
    """Whether a find can be of a kind at all."""
    plain = _plain(found)
    digits = "".join(_DIGITS.findall(plain))
    if kind == "email":
        return re.fullmatch(r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+", plain) is not None
    if "@" in plain:
        return False
    if kind == "ip":
        return shape(found).split()[2][1] == "1"
    return (16 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 8 <= len(digits) <= 15


def _likeness(found: str) -> str:
    """Key of nodes that resemble one another: a whole address, or the last nine digits."""
    plain = _plain(found)
    return plain if "@" in plain else "".join(_DIGITS.findall(plain))[-9:]


@dataclass
class Graph:
    """Nodes of some texts: text, place, label so far (0 for a candidate), shape; chain and skip edges; the candidates
    that resemble a find of their text."""

    nodes: list[tuple[int, int, int, int, str]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    unlabelled: set[int] = field(default_factory=set)

    def add(self, number: int, text: str, base: list[Span]) -> None:
        rows = {(a, b): LABELS.index(kind) for kind, a, b in reversed(base)}
        rows.update({span: 0 for span in _candidates(text, base)})
        alike: dict[str, list[int]] = {}
        for k, ((a, b), label) in enumerate(sorted(rows.items())):
            node = len(self.nodes)
            self.nodes.append((number, a, b, label, shape(text[a:b])))
            if k:
                self.chain.append((node - 1, node))
            alike.setdefault(_likeness(text[a:b]), []).append(node)
        for mentions in alike.values():
            first = next((n for n in mentions if self.nodes[n][3]), None)
            if first is None:
                self.skip += zip(mentions, mentions[1:])
                continue
            self.skip += ((min(first, n), max(first, n)) for n in mentions if n != first)
            self.unlabelled.update(n for n in mentions if not self.nodes[n][3])


def _scanned(column: pa.Array) -> Iterator[tuple[int, str, list[Span]]]:
    """Number, text and pattern finds of the texts that hold a digit or an address sign."""
    for part in texts(column):
        marks = np.concatenate(([0], np.cumsum(_FLAGS[part.data])))[part.at]
        some = np.diff(marks) > 0
        if _VEILS.search(part.data):
            some |= np.array([_VEILS.search(part.data[a:b]) is not None for a, b in zip(part.at[:-1], part.at[1:])])
        for k in np.flatnonzero(some).tolist():
            text = part.data[part.at[k] : part.at[k + 1]].tobytes().decode()
            yield part.first + k, text, base_spans(text)


def _counts(docs: DataFrame) -> Counter:
    """Counts of (shape, label), (chain, label pair) and (skip, label pair) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            graph = Graph()
            for number, text, base in _scanned(batch.column(0)):
                graph.add(number, text, base)
            label, open_ = [n[3] for n in graph.nodes], graph.unlabelled
            seen.update((n[4], n[3], 0) for k, n in enumerate(graph.nodes) if k not in open_)
            for name, edges in (("chain", graph.chain), ("skip", graph.skip)):
                seen.update((name, *sorted((label[a], label[b]))) for a, b in edges if a not in open_ and b not in open_)
        if seen:
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["what", "a", "b", "n"]
            )

    rows = docs.select("text").mapInArrow(run, "what string, a int, b int, n long")
    found = rows.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Counter({(r.what, r.a, r.b): r.n for r in found})


@dataclass
class Field:
    """Log potentials: of a node by its shape's attributes, and of label pairs on both kinds of edges."""

    attributes: dict[tuple[int, str], int]
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, shapes: list[str]) -> np.ndarray:
        out = np.zeros((len(shapes), len(LABELS)))
        known = {}
        for k, s in enumerate(shapes):
            if s not in known:
                rows = [self.attributes[x] for x in enumerate(s.split()) if x in self.attributes]
                known[s] = self.weights[0] + self.weights[rows].sum(axis=0)
            out[k] = known[s]
        return out


def learn(docs: DataFrame, p: SkipChain) -> Field:
    """The field of the texts of ``docs`` (column text)."""
    counts = _counts(docs)
    pairs = {}
    for name in ("chain", "skip"):
        table = np.full((len(LABELS),) * 2, p.other)
        np.fill_diagonal(table, p.same if name == "skip" else p.other)
        for (what, a, b), n in counts.items():
            if what == name:
                table[a, b] += n
                table[b, a] += n
        alone = table.sum(axis=0) / table.sum()
        pairs[name] = np.log(table / table.sum() / alone[:, None] / alone)
    shapes = sorted({k[0] for k in counts} - {"chain", "skip"})
    attributes: dict[tuple[int, str], int] = {}
    for s in shapes:
        for x in enumerate(s.split()):
            attributes.setdefault(x, len(attributes) + 1)
    design = np.zeros((len(shapes), len(attributes) + 1))
    design[:, 0] = 1
    for k, s in enumerate(shapes):
        design[k, [attributes[x] for x in enumerate(s.split())]] = 1
    seen = np.array([[counts[s, label, 0] for label in range(len(LABELS))] for s in shapes], float).reshape(-1, len(LABELS))
    return Field(attributes, _logistic(design, seen, p.penalty), pairs["chain"], pairs["skip"])


def _logistic(design: np.ndarray, seen: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of a multinomial logistic model of counted rows, by Newton steps one label at a time."""
    weights = np.zeros((design.shape[1], seen.shape[1]))
    n = seen.sum(axis=1)
    for _ in range(60):
        before = weights.copy()
        for label in range(seen.shape[1]):
            g = design @ weights
            g = np.exp(g - g.max(axis=1, keepdims=True))
            share = g[:, label] / g.sum(axis=1)
            slope = design.T @ (n * share - seen[:, label]) + penalty * weights[:, label]
            bend = (design * (n * share * (1 - share))[:, None]).T @ design + np.eye(len(weights)) * (penalty + 1e-6)
            step = np.linalg.solve(bend, slope)
            weights[:, label] -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(weights - before).max() < 1e-4:
            break
    return weights


def marginals(field: Field, graph: Graph, p: SkipChain) -> np.ndarray:
    """Label probabilities of all nodes from damped sum-product messages that have settled; found nodes are fixed."""
    unary = field.unary([n[4] for n in graph.nodes])
    label = np.array([n[3] for n in graph.nodes], np.int64)
    fixed = np.flatnonzero(label)
    unary[fixed] = -50.0
    unary[fixed, label[fixed]] = 0.0
    edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    pair = np.stack([field.chain] * len(graph.chain) + [field.skip] * len(graph.skip)) if len(edges) else np.zeros((0, 5, 5))
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.concatenate([pair, pair])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), len(LABELS)))
    for _ in range(p.rounds if len(source) else 0):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        fresh = np.logaddexp.reduce((belief[source] - messages[back])[:, :, None] + pair, axis=1)
        fresh -= fresh.max(axis=1, keepdims=True)
        change = (1 - p.damping) * (fresh - messages)
        messages = messages + change
        if np.abs(change).max() <= p.tolerance:
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def _written(spans: list[Span]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def personal_data(docs: DataFrame, p: SkipChain = SkipChain(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data of every row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the patterns' finds; ``spans`` has those and the field's additions as
    kind:start:end, in code points. A null text is empty and has none; a long one is one field, whole. Repeated rows are learned from and
    searched each; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(learn(source, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: dict[int, list[Span]] = {}
            added: dict[int, list[Span]] = {}
            held: dict[int, str] = {}
            graph = Graph()
            for number, text_, spans in _scanned(batch.column(1)):
                base[number] = spans
                nodes = len(graph.nodes)
                graph.add(number, text_, spans)
                if any(n[3] == 0 for n in graph.nodes[nodes:]):
                    held[number] = text_
            if held:
                chance = marginals(field.value, graph, p)
                best = chance.argmax(axis=1)
                for (number, a, b, label, _), k, c in zip(graph.nodes, best.tolist(), chance.max(axis=1).tolist()):
                    if not label and k and c >= p.least and _fits(LABELS[k], held[number][a:b]):
                        added.setdefault(number, []).append((LABELS[k], a, b))
            rows = [base.get(k, []) for k in range(batch.num_rows)]
            written = [_written(x) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(s[0] == kind for s in x) for x in rows], pa.int64()) for kind in KINDS),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in written]),
                    pa.array([_written(x + added[k]) if k in added else w for k, (x, w) in enumerate(zip(rows, written))]),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return source.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
