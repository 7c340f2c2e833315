"""Document quality learned from trusted positives and unlabelled text.

A logistic model minimises the non-negative unbiased risk: prior * risk+(positives) + max(0, risk-(unlabelled)
- prior * risk-(positives)). For the logistic loss this is convex as long as the second term is positive, so
Newton steps over the whole corpus are taken; a step that would drive the second term below zero is halved
until it doesn't, and fitting ends when no step is left. The class prior is estimated before, from a model that
tells positives from unlabelled rows: the smallest share of unlabelled rows above a score over the
share of positives above it.

Every pass sums over all rows on the executors; only sums of the size of the model reach the driver. Negative
labels are never used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.rules import SYMBOLS, line_counts, repeated_words
from pathpulse.llm.store import held_out, keep
from pathpulse.llm.words import SPACE, Text, mix, texts, words

_CLASSES = [
    np.isin(np.arange(256), np.frombuffer(x, np.uint8))
    for x in (SYMBOLS, b"0123456789", bytes(range(65, 91)), b"!?", b".,;:", bytes(range(97, 123)))
]
N_FEATURES = 16


@dataclass(frozen=True)
class PositiveUnlabelled:
    """Penalty of the weights, Newton steps, and the fold that is never learned from."""

    penalty: float = 0.01
    steps: int = 12
    modulus: int = 5
    threshold: float = 0.3
    least_share: float = 0.3


def features(part: Text) -> np.ndarray:
    """Measures of some texts, one row each; a text without words has zeros."""
    w = words(part)
    n = np.diff(w.of)
    some = np.maximum(n, 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[part.at])

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[w.of])

    symbols, digits, upper, calls, stops, lower = (per_text(c[part.data]) for c in _CLASSES)
    chars = per_text((part.data & 0xC0 != 0x80) & ~SPACE[part.data])
    foreign = per_text(part.data >= 0xC0)
    lines, dup = line_counts(part, w)
    text = w.text_ids()
    size = w.ends - w.starts
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    kinds = np.bincount(text[np.unique(w.hashes ^ mix(text.astype(np.uint64)), return_index=True)[1]], minlength=len(n))
    glyphs = np.maximum(chars, 1)
    return np.column_stack(
        [
            np.log1p(n), chars / some, symbols / glyphs, digits / glyphs, upper / np.maximum(upper + lower + foreign, 1),
            calls / some, stops / some, dup / np.maximum(lines, 1), repeated_words(w, 8) / some, repeated_words(w, 2) / some,
            np.log1p(kinds) / np.log1p(some), np.log1p(n / np.maximum(lines, 1)), per_word(same) / some,
            per_word(size <= 2) / some, per_word(size >= 12) / some, foreign / glyphs,
        ]
    )


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id and x of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch.column(1)):
                x = features(part)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), rows], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_FEATURES)


@dataclass
class Model:
    """Centre and scale of the features, and weights of their hinges (None: nothing learned)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    prior: float = 0.5

    def design(self, x: np.ndarray) -> np.ndarray:
        """1, every standardised feature, and what of it lies beyond one deviation on either side."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -40, 40)))


def _summed(rows: DataFrame, sums) -> np.ndarray:
    """Sum over all rows of ``sums(x, positive)``, an array of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.select("x", "positive").mapInArrow(run, "sums array<double>")
    found = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("x")).collect()
    return np.array([r.x for r in sorted(found)])


def _soft(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def _newton(rows: DataFrame, model: Model, start: np.ndarray, counts: tuple[float, float], p: PositiveUnlabelled, prior: float | None) -> np.ndarray:
    """Weights of least risk; without a prior, of the model that tells positives from unlabelled rows."""
    n, n_pos = counts
    d = len(start)
    w = start
    shrink = np.full(d, p.penalty)
    shrink[0] = 0.0
    halves = 0.5 ** np.arange(8)

    def parts(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        a = model.design(x)
        g = a @ w
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        pos = a[positive]
        if prior is None:
            sp = s[positive]
            gradient = a.T @ s / n - pos.T @ (1 - sp) / n_pos
            bend = (a * (s * (1 - s))[:, None]).T @ a / n + (pos * (sp * (1 - sp))[:, None]).T @ pos / n_pos
        else:
            gradient = a.T @ s / n - prior * pos.sum(axis=0) / n_pos
            bend = (a * (s * (1 - s))[:, None]).T @ a / n
        return np.concatenate([gradient, bend.ravel()])

    for _ in range(p.steps):
        found = _summed(rows, parts)
        gradient = found[:d] + shrink * w
        step = np.linalg.solve(found[d:].reshape(d, d) + np.diag(shrink + 1e-9), gradient)
        tries = [w - h * step for h in halves]

        def risks(x: np.ndarray, positive: np.ndarray, tries=tries) -> np.ndarray:
            g = model.design(x) @ np.array([w, *tries]).T
            gp = g[positive]
            if prior is None:
                return np.concatenate([_soft(g).sum(axis=0) / n + _soft(-gp).sum(axis=0) / n_pos, np.ones(len(tries) + 1)])
            negative = _soft(g).sum(axis=0) / n - prior * _soft(gp).sum(axis=0) / n_pos
            return np.concatenate([prior * _soft(-gp).sum(axis=0) / n_pos + negative, negative])

        risk, negative = _summed(rows, risks).reshape(2, -1)
        risk = risk + 0.5 * np.array([(shrink * v * v).sum() for v in (w, *tries)])
        good = np.flatnonzero((negative[1:] >= 0) & (risk[1:] < risk[0] - 1e-7))
        if not len(good):
            break
        best = good[np.argmin(risk[1:][good])]
        w = tries[best]
        if risk[0] - risk[1 + best] < 1e-6:
            break
    return w


def _prior(rows: DataFrame, model: Model, w: np.ndarray, counts: tuple[float, float], p: PositiveUnlabelled) -> float:
    """Smallest ratio of the shares of unlabelled and positive rows above a score."""
    edges = np.linspace(-20, 20, 801)

    def histogram(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        g = np.clip(model.design(x) @ w, -19.99, 19.99)
        return np.concatenate([np.histogram(y, edges)[0].astype(float) for y in (g, g[positive])])

    both = _summed(rows, histogram).reshape(2, -1)
    above = np.cumsum(both[:, ::-1], axis=1)[:, ::-1] / np.array(counts)[:, None]
    u, v = above[:, above[1] >= p.least_share]
    return float(np.clip((u / v).min(), 0.01, 0.99))


def learn(measured: DataFrame, labels: DataFrame, p: PositiveUnlabelled, doc_id: str = "doc_id", quality: str = "quality") -> Model:
    """Model of the learned fold's rows of ``measured`` (doc_id, x) and the positives among ``labels``."""
    trusted = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("doc_id")).distinct().withColumn("positive", F.lit(True))
    rows = keep(
        measured.where(~held_out("doc_id", p.modulus))
        .join(trusted, "doc_id", "left")
        .select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    )
    plain = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    moments = _summed(rows, lambda x, positive: np.concatenate([[len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if not len(moments) or not moments[1]:
        return plain
    n, n_pos = moments[:2]
    mean = moments[2 : 2 + N_FEATURES] / n
    spread = np.sqrt(np.maximum(moments[2 + N_FEATURES :] / n - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))
    start = np.zeros(1 + 3 * N_FEATURES)
    apart = _newton(rows, model, start, (n, n_pos), p, None)
    model.prior = _prior(rows, model, apart, (n, n_pos), p)
    start[0] = np.log(model.prior / (1 - model.prior))
    model.weights = _newton(rows, model, start, (n, n_pos), p, model.prior)
    return model


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, p: PositiveUnlabelled = PositiveUnlabelled(), doc_id: str = "doc_id", text: str = "text", quality: str = "quality"
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    score estimates the probability of label 1 from the text alone. Learned from are rows whose crc32(doc_id as
    text) doesn't leave 0; rows without id count as held out. A null text is empty. A document is a trusted
    positive if any of its labels is 1. Without trusted positives nothing is learned and every score is 0.5.
    Repeated rows are learned from and scored each; other columns are ignored; an empty table gives an
    empty result.
    """
    measured = keep(_measured(_source(docs, doc_id, text)))
    model = docs.sparkSession.sparkContext.broadcast(learn(measured, labels, p, doc_id, quality))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    kind = measured.schema["doc_id"].dataType.simpleString()
    scored = measured.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out("doc_id", p.modulus).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted")
    )


def quality_kept(
    docs: DataFrame, labels: DataFrame, p: PositiveUnlabelled = PositiveUnlabelled(), doc_id: str = "doc_id", text: str = "text", quality: str = "quality"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold (see ``quality_scores``)."""
    measured = keep(_measured(_source(docs, doc_id, text)))
    model = docs.sparkSession.sparkContext.broadcast(learn(measured, labels, p, doc_id, quality))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(features(part)) for part in texts(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate(scores) >= p.threshold)) if scores else batch

    return docs.mapInArrow(run, docs.schema)
