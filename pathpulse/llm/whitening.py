"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Counts, sums and the covariance are gathered by Spark in two passes; only arrays of the vectors' dimension reach the
driver. There the covariance's invariant subspaces are split recursively: the polar factor U of the shifted
covariance, from the dynamically weighted Halley iteration, gives the projector (U + I) / 2 on the components above
the shift, whose range and its complement are split in turn. The first components go to the tasks, which project
every vector; a last pass over the whitened values measures how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.store import keep

#: Larger whole entries are no exact doubles; rows that hold one count as not finite.
LARGEST = float(1 << 52)


@dataclass(frozen=True)
class Whitening:
    """An entry c becomes floor(scale * c) + offset; the first ``components`` are kept."""

    components: int = 8
    scale: int = 1024
    offset: int = 100_000


# --- spectral divide-and-conquer on the driver: matrices of the vectors' dimension ---


def polar(a: np.ndarray, least: float = 1e-17) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by the QR form of the weighted Halley iteration."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = least
    eye = np.eye(n)
    for _ in range(30):
        # weights that raise the smallest singular value fastest
        d = np.cbrt(4 * (1 - low**2) / low**4)
        w = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = b / c * x + (w - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        step = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (w + b * low**2) / (1 + c * low**2))
        if step <= 1e-14 * np.sqrt(n) and 1 - low < 1e-10:
            break
    return x


def _halves(a: np.ndarray, shift: float, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``; None if an eigenvalue sits on it."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-10 * np.sqrt(n):
        return None
    start = projector @ np.random.default_rng(seed).standard_normal((n, rank))
    above, _ = np.linalg.qr(projector @ np.linalg.qr(start)[0])
    whole, _ = np.linalg.qr(above, mode="complete")
    below = whole[:, rank:]
    below, _ = np.linalg.qr(below - projector @ below)
    return above, below


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Parts whose eigenvalues agree to working precision are not split further: any basis of theirs is one of
    eigenvectors.
    """
    n = len(covariance)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    covariance = (covariance + covariance.T) / 2
    size = np.linalg.norm(covariance)
    values, vectors = [], []
    parts = [(covariance, np.eye(n))]
    while parts:
        a, basis = parts.pop()
        m = len(a)
        mean = np.trace(a) / m
        diagonal = np.diag(a)
        if m == 1 or np.linalg.norm(a - np.diag(diagonal)) <= 4e-16 * size:
            values += list(diagonal)
            vectors += list(basis.T)
            continue
        # the mean lies between the ends of the spectrum, so it splits unless it hits an eigenvalue
        spread = np.linalg.norm(a - mean * np.eye(m))
        near = mean + spread / m * np.random.default_rng(m).uniform(-0.7, 0.7, 30)
        tries = [np.median(diagonal), mean, *near]
        found = next((h for k, t in enumerate(tries) if (h := _halves(a, t, k)) is not None), None)
        if found is None:
            raise ArithmeticError("no shift splits the spectrum")
        for q in found:
            part = q.T @ a @ q
            parts.append(((part + part.T) / 2, basis @ q))
    order = np.argsort(-np.array(values), kind="stable")
    columns = np.array(vectors)[order].T
    return np.array(values)[order], columns / np.linalg.norm(columns, axis=0)


# --- passes over the vectors ---


def whole_entries(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * c) + offset of every entry, as doubles (exact below 2^52); NULL unless all are there and finite."""
    x = vector.cast("array<double>")
    fits = lambda c: F.abs(c) <= LARGEST / scale  # noqa: E731  (not so for NaN, which is above all)
    made = F.transform(x, lambda c: F.when(fits(c), F.floor(c * float(scale)).cast("double") + float(offset)))
    bad = F.exists(x, lambda c: c.isNull() | ~fits(c))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), made)


def commonest_length(rows: DataFrame) -> int:
    """Length of most lists ``x`` (the longest in a tie); 1 for an empty table."""
    first = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).first()
    return first[0] if first else 1


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of ``dim`` doubles each."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _summed(parts: DataFrame) -> np.ndarray:
    """Sum over the rows of ``parts`` (values array<double>), place by place; places are bounded by the dimension."""
    places = parts.select(F.posexplode("values").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return np.array([r.v for r in sorted(places.collect())])


def _covariance(rows: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of the list column ``x`` about ``mean``: one matrix from each task, summed."""
    dim = len(mean)
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = as_matrix(batch.column(0), dim) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total[upper]], pa.list_(pa.float64()))], names=["values"])

    out = np.zeros((dim, dim))
    out[upper] = _summed(rows.select("x").mapInArrow(run, "values array<double>")) / n
    return out + np.triu(out, 1).T


def _exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of the whole numbers at each place of ``x``."""
    n = rows.count()
    exact = F.sum(F.col("v").cast("decimal(20,0)"))
    sums = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(exact.alias("s"))
    return n, [int(r.s) for r in sorted(sums.collect())]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """sum (n x - S)^2 of every row, exactly; None beyond 38 digits.

    With S = n q + r and u = x - q that is n^2 sum u^2 - 2 n sum u r + sum r^2, of which all but the last step
    stays in 64 bits for vectors of usual size.
    """
    q = np.array([s // n for s in sums])
    r = np.array([s % n for s in sums])
    u = x.astype(np.int64) - q
    top = int(np.abs(u).max(initial=1))
    if top * max(top, n) * max(1, len(q)) >= 1 << 62:
        u, r = u.astype(object), r.astype(object)
    squares, cross = (u * u).sum(1).astype(object), (u * r).sum(1).astype(object)
    rest = sum(int(v) ** 2 for v in r)
    exact = n * n * squares - 2 * n * cross + rest
    return [Decimal(int(v)) if v < 10**38 else None for v in exact]


def whitened(vectors: DataFrame, p: Whitening = Whitening(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened array, explained array, identity_error): a row for every vector that counts.

    Rows whose vector is null, holds a null or non-finite entry, or one beyond 2^52 after scaling, are dropped, and
    so are vectors of another length than the commonest one (the longest of those, in a tie) and empty ones.
    Repeated rows and null ids count each. ``deviation`` is decimal(38,0), NULL beyond that. A component
    without variance (eigenvalue under dimension * 1e-15 of all) has whitened and explained 0 and is
    left out of identity_error; with equal eigenvalues any basis of theirs may come. Other columns are ignored; an
    empty table gives an empty result.
    """
    made = vectors.select(vectors[vec_id].alias("vec_id"), whole_entries(vectors[vector], p.scale, p.offset).alias("x")).where("x is not null and size(x) > 0")
    rows = keep(made)
    dim = commonest_length(rows)
    rows = rows.where(F.size("x") == dim)
    n, sums = _exact_sums(rows)
    if n:
        mean = np.array([s // n for s in sums]) + np.array([(s % n) / n for s in sums])
        values, columns = components(_covariance(rows, mean, n))
    else:
        mean, values, columns = np.zeros(dim), np.zeros(dim), np.eye(dim)
    total = values.sum()
    some = (values > dim * 1e-15 * total) & (total > 0)
    count = min(p.components, dim)
    # dim x components numbers, sent to the tasks with the function that uses them
    plane = np.where(some, columns / np.sqrt(np.where(some, values, 1.0)), 0.0)[:, :count]
    whole, rest = np.array([s // max(n, 1) for s in sums], np.float64), np.array([(s % max(n, 1)) / max(n, 1) for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(1), dim)
            z = ((x - whole) - rest) @ plane
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(_deviations(x, n, sums), pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(np.arange(0, z.size + 1, count, dtype=np.int32), z.ravel()),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = keep(rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"))
    error = 0.0
    if n and (active := np.flatnonzero(some[:count])).size:
        z = out.select(F.col("whitened").alias("x"))
        centre = _summed(z.select(F.col("x").alias("values"))) / n
        error = float(np.abs((_covariance(z, centre, n) - np.eye(count))[np.ix_(active, active)]).max())
    explained = (np.where(some, values, 0.0) / (total or 1.0))[:count]
    return out.select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(float(v)) for v in explained]).alias("explained"), F.lit(error).alias("identity_error"),
    )


def whitened_components(vectors: DataFrame, p: Whitening = Whitening()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    ``deviation`` is NULL where it exceeds a long.
    """
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    made = whitened(vectors, p).withColumn("deviation", F.col("deviation").try_cast("long"))
    return made.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )
