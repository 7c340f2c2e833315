"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is bound into one vector: the first
letter's vector rotated by two places times the second's rotated by one times the third's. A text is the sum
of the vectors of its runs, a language the sum over its texts, each weighed by one over its runs. The
languages' common part (their mean) is taken off, and a text gets the language of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.store import key_hash
from pathpulse.llm.words import Text, texts

#: Runs of letters whose vectors are built at a time.
_COLUMNS = 2048
MOST_LANGUAGES = 1000


@dataclass(frozen=True)
class Profiles:
    """``size`` of the vectors, their ``seed``, and the texts learned from: those of another remainder."""

    size: int = 1024
    seed: int = 5
    modulus: int = 4
    remainder: int = 2


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for everything else."""
    out = np.zeros(0x110000, np.int64)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


_vectors: dict[tuple[int, int, int], np.ndarray] = {}


def _vector(code: int, p: Profiles) -> np.ndarray:
    key = (code, p.size, p.seed)
    if key not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        _vectors[key] = np.random.default_rng([p.seed, code]).integers(0, 2, p.size).astype(np.int8) * 2 - 1
    return _vectors[key]


@dataclass
class Runs:
    """Distinct runs of three letters of some texts, and which run of which text occurs."""

    codes: np.ndarray
    run: np.ndarray
    text: np.ndarray
    of_text: np.ndarray

    def bound(self, low: int, high: int, p: Profiles) -> np.ndarray:
        """Vectors of the distinct runs low to high."""
        codes = self.codes[low:high]
        out = np.ones((len(codes), p.size), np.int8)
        for shift, place in ((2, 42), (1, 21), (0, 0)):
            letters, which = np.unique(codes >> place & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(_vector(int(c), p), shift) for c in letters])[which]
        return out.astype(np.float32)

    def bundles(self, rows: np.ndarray, weights: np.ndarray, n: int, p: Profiles) -> np.ndarray:
        """Weighed sums of run vectors by row; ``rows`` and ``weights`` belong to the occurrences."""
        out = np.zeros((n, p.size))
        order = np.argsort(self.run, kind="stable")
        run, rows, weights = self.run[order], rows[order], weights[order]
        for low in range(0, len(self.codes), _COLUMNS):
            a, b = np.searchsorted(run, [low, low + _COLUMNS])
            width = min(_COLUMNS, len(self.codes) - low)
            counts = np.bincount(rows[a:b] * width + run[a:b] - low, weights[a:b], n * width)
            out += counts.reshape(n, width).astype(np.float32) @ self.bound(low, low + width, p)
        return out


def runs(part: Text) -> Runs:
    """Runs of three letters of some texts; other signs between letters count as one blank."""
    letters = _letters()[np.frombuffer(part.data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    at = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))[part.at]
    # a blank before and after every text, then no blank after a blank
    letters = np.insert(np.insert(letters, at[1:], 0), at[:-1] + np.arange(len(part)), 0)
    text = np.repeat(np.arange(len(part)), np.diff(at) + 2)
    again = np.zeros(len(letters), bool)
    again[1:] = (letters[1:] == 0) & (letters[:-1] == 0) & (text[1:] == text[:-1])
    letters, text = letters[~again], text[~again]
    same = text[2:] == text[:-2] if len(text) > 2 else np.zeros(0, bool)
    codes = (letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])[same]
    distinct, run = np.unique(codes, return_inverse=True)
    text = text[2:][same]
    return Runs(distinct, run, text, np.bincount(text, minlength=len(part)))


#: Sums are carried as integers of this unit, so that they don't depend on their order.
_UNIT = 1 << 24


def prototypes(docs: DataFrame, p: Profiles) -> tuple[list[str], np.ndarray]:
    """Names and vectors of the languages of the learned texts (columns text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in texts(batch.column(0)):
                found = runs(part)
                names, lang = np.unique(batch.column(1).slice(part.first, len(part)).to_pylist(), return_inverse=True)
                rows = found.bundles(lang[found.text], 1 / found.of_text[found.text], len(names), p)
                for name, row in zip(names.tolist(), rows):
                    sums[name] = sums.get(name, 0) + np.rint(row * _UNIT).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"]
            )

    parts = docs.select("text", "lang").mapInArrow(run, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"at most {MOST_LANGUAGES} languages are learned")
    vectors = np.array([[e.x for e in r.v] for r in rows], float).reshape(len(rows), p.size)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    if len(rows) > 1:
        vectors -= vectors.mean(axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    return [r.lang for r in rows], vectors


def languages(docs: DataFrame, p: Profiles = Profiles(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Learned from are rows with text, lang and id whose crc32(doc_id as text) leaves another remainder; rows
    without id count as held out. lang_pred is the learned language of the largest cosine, ties going to the
    first name; ``und`` with score 0 where the text is null or has no letter, or nothing was learned. score is
    the cosine, or 0 if negative. Repeated rows are learned from and judged each; other columns are
    ignored; an empty table gives an empty result. More than 1,000 languages raise ValueError.
    """
    held = F.coalesce(key_hash(doc_id) % p.modulus == p.remainder, F.lit(True))
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), held.alias("held_out")
    )
    names, vectors = prototypes(source.where("not held_out and lang is not null and text is not null"), p)
    sent = docs.sparkSession.sparkContext.broadcast((names, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        for batch in batches:
            for part in texts(batch.column(2)):
                found = runs(part)
                rows = found.bundles(found.text, np.ones(len(found.text)), len(part), p)
                norm = np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
                cosines = rows / norm @ vectors.T if names else np.zeros((len(part), 1))
                some = (found.of_text > 0) & bool(names)
                best = cosines.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(part.first, len(part)) for k in (0, 1)),
                        pa.array([names[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]),
                        pa.array(np.where(some, np.clip(cosines[np.arange(len(part)), best], 0, 1), 0.0)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
