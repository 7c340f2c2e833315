"""Hard negatives by maximum inner product search in cover trees.

Candidates get one more coordinate that brings them all to the norm of the longest, so that inner products with an
anchor fall with the distance. Pivots picked farthest first are the top of the tree: each candidate belongs to its
nearest pivot, and the candidates of a pivot are dealt by hash into blocks of bounded size. A block's cover tree is built in
one task: the children of a node are centres further apart than its level's covering radius, each with the farthest
of its points as its own radius. A node's centre and radius bound the inner products of all its points from both
sides. An anchor visits the blocks of its own pivot first, then those whose bounds reach what it found; in a block,
nodes are taken best first, nodes outside of all its windows are skipped, and points are scored exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathpulse.llm.store import keep
from pathpulse.llm.whitening import as_matrix, commonest_length, whole_entries

#: Vectors longer than this after scaling have no exact inner products in doubles.
LONGEST = float(1 << 26)
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mining:
    """An entry c becomes floor(scale * c). Each anchor has its first ``positives`` rows of its label; each of these
    gets the first ``negatives`` rows of other labels whose score lies from low_percent to high_percent of its own.

    A block holds about ``block_rows`` rows, a unit of search about ``unit_anchors`` anchors. Pivots, ``most_pivots``
    at most, come from ``sample_rows`` rows, the first by hash; the sample only decides how rows are grouped.
    """

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    high_percent: int = 100
    block_rows: int = 4096
    unit_anchors: int = 1024
    most_pivots: int = 256
    sample_rows: int = 4096
    leaf_rows: int = 24
    base: float = 1.3


# --- one cover tree ---


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with one more coordinate that makes them ``norm`` long."""
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))])


def farthest_first(points: np.ndarray, first: int, enough: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, each point's nearest centre and its distance.

    Begins at ``first`` and adds the farthest point until all lie within ``enough``, or ``most`` centres are found.
    """
    def distances(at: int) -> np.ndarray:
        return np.sqrt(np.maximum(lengths + lengths[at] - 2 * (points @ points[at]), 0))

    lengths = (points * points).sum(1)
    centres, near, which = [first], distances(first), np.zeros(len(points), np.int64)
    while len(centres) < most:
        far = int(near.argmax())
        if near[far] <= enough:
            break
        d = distances(far)
        closer = d < near
        near[closer], which[closer] = d[closer], len(centres)
        centres.append(far)
    return centres, which, near


@dataclass
class Tree:
    """Nodes with a centre (row), a radius, rows of their own and children; node 0 is the root."""

    centre: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    row_at: np.ndarray
    children: np.ndarray
    child_at: np.ndarray


def cover_tree(points: np.ndarray, norm: float, p: Mining = Mining()) -> Tree:
    """The tree over augmented points; every row is the own row of one node."""
    tiny = 1e-6 * norm
    first = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    centres, radii, own, kids = [], [], [], []

    def add(rows: np.ndarray, centre: int) -> int:
        centres.append(centre)
        radii.append(float(np.sqrt(((points[rows] - points[centre]) ** 2).sum(1).max())))
        own.append(np.zeros(0, np.int64))
        kids.append([])
        return len(centres) - 1

    todo = [(add(np.arange(len(points)), first), np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= p.leaf_rows or radii[node] <= tiny:
            own[node] = rows
            continue
        at = int(np.flatnonzero(rows == centres[node])[0])
        found, which, _ = farthest_first(points[rows], at, radii[node] / p.base, len(rows))
        sizes = np.bincount(which, minlength=len(found))
        # a centre without company needs no node
        own[node] = rows[sizes[which] == 1]
        for k in np.flatnonzero(sizes > 1):
            part = rows[which == k]
            child = add(part, int(rows[found[k]]))
            kids[node].append(child)
            todo.append((child, part))
    flat = lambda lists: (np.concatenate([np.asarray(x, np.int64) for x in lists]), np.concatenate(([0], np.cumsum([len(x) for x in lists]))))
    return Tree(np.array(centres), np.array(radii), *flat(own), *flat(kids))


def bounds(scores: np.ndarray, lengths: np.ndarray, radius: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of anchors (rows) with any point of balls on the sphere of radius ``norm``.

    ``scores`` are the inner products with the centres. A chord of the radius is an angle; products follow the cosine.
    """
    size = np.maximum(lengths * norm, 1e-300)[:, None]
    angle = np.arccos(np.clip(scores / size, -1, 1))
    width = 2 * np.arcsin(np.minimum((radius + 1e-7 * norm) / (2 * norm), 1))
    slack = 1e-9 * size + 1e-3
    return size * np.cos(np.minimum(angle + width, np.pi)) - slack, size * np.cos(np.maximum(angle - width, 0)) + slack


class Best:
    """The first ``k`` rows found for each anchor and window: higher scores first, then smaller ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high = low, high
        self.scores = np.full((*low.shape, k), -np.inf)
        self.ids = np.full((*low.shape, k), NONE, np.int64)

    def floor(self) -> np.ndarray:
        return np.maximum(self.low, self.scores[:, :, -1])

    def offer(self, anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """``scores`` and ``allowed`` are anchors x rows."""
        k = self.scores.shape[2]
        for w in range(self.low.shape[1]):
            last, last_id = self.scores[anchors, w, -1][:, None], self.ids[anchors, w, -1][:, None]
            better = (scores > last) | ((scores == last) & (ids[None, :] < last_id))
            fits = allowed & better & (scores >= self.low[anchors, w][:, None]) & (scores <= self.high[anchors, w][:, None])
            a, r = np.nonzero(fits)
            if not len(a):
                continue
            some = np.unique(a)
            old = anchors[some]
            who = np.concatenate([a, np.repeat(some, k)])
            score = np.concatenate([scores[a, r], self.scores[old, w].ravel()])
            name = np.concatenate([ids[r], self.ids[old, w].ravel()])
            order = np.lexsort((name, -score, who))
            starts = np.searchsorted(who[order], some)
            take = order[starts[:, None] + np.arange(k)]
            self.scores[old, w], self.ids[old, w] = score[take], name[take]


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm: float, anchors: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray, same: bool, best: Best) -> None:
    """Fill ``best`` with the rows of the tree that lie in the anchors' windows."""
    lengths = np.sqrt((anchors * anchors).sum(1))
    everyone = np.arange(len(anchors))
    score = anchors @ x[tree.centre[0]]
    low, high = bounds(score[:, None], lengths, tree.radius[:1], norm)
    heap = [(-float(high.max(initial=0)), 0, everyone, low[:, 0], high[:, 0])]
    while heap:
        _, node, who, low, high = heapq.heappop(heap)
        wanted = ((high[:, None] >= best.floor()[who]) & (low[:, None] <= best.high[who])).any(1)
        who = who[wanted]
        if not len(who):
            continue
        rows = tree.rows[tree.row_at[node] : tree.row_at[node + 1]]
        step = max(64, 500_000 // len(who))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            alike = labels[part][None, :] == own_labels[who][:, None]
            allowed = alike & (ids[part][None, :] != own_ids[who][:, None]) if same else ~alike
            best.offer(who, ids[part], anchors[who] @ x[part].T, allowed)
        kids = tree.children[tree.child_at[node] : tree.child_at[node + 1]]
        if len(kids):
            lows, highs = bounds(anchors[who] @ x[tree.centre[kids]].T, lengths[who], tree.radius[kids], norm)
            for k, kid in enumerate(kids):
                heapq.heappush(heap, (-float(highs[:, k].max()), int(kid), who, lows[:, k], highs[:, k]))


# --- the forest of all blocks ---


@dataclass(frozen=True)
class Pivots:
    """Top of the tree: augmented centres, how far their rows lie, and in how many blocks these are."""

    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    norm: float


def _placed(rows: DataFrame, dim: int, p: Mining) -> tuple[DataFrame, Pivots]:
    """``rows`` (vec_id, label, x) with their pivot and part, and the pivots."""
    n, square = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))).first()
    norm = max(1.0, float(np.sqrt(square or 0.0)))
    # of four times as many rows by the hash's low bits, so that what the tasks send doesn't grow with their number
    some = F.xxhash64("vec_id", "x").bitwiseAND(F.lit((1 << 40) - 1)) < F.lit((1 << 40) * 4 * p.sample_rows // max(n, 1))
    few = rows.where(some).orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(p.sample_rows).select("x").collect() if n else []
    sample = augmented(np.array([r.x for r in few], float).reshape(-1, dim), norm)
    count = min(p.most_pivots, max(1, -(-n // p.block_rows)))
    chosen = farthest_first(sample, 0, 0.0, count)[0] if len(sample) else []
    centres = sample[chosen] if chosen else augmented(np.zeros((1, dim)), norm)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = augmented(as_matrix(batch.column(2), dim), norm) @ centres.T
                at = scores.argmax(1)
                far = np.sqrt(np.maximum(2 * norm**2 - 2 * scores[np.arange(len(at)), at], 0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], names=["vec_id", "label", "x", "pivot", "far"])

    placed = keep(rows.mapInArrow(nearest, "vec_id long, label long, x array<double>, pivot int, far double"))
    counts = {r.pivot: r for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    used = [counts.get(k) for k in range(len(centres))]
    radius = np.array([r.far if r else 0.0 for r in used])
    parts = np.array([-(-r.n // p.block_rows) if r else 0 for r in used], np.int64)
    table = F.array(*[F.lit(int(k)) for k in parts]) if len(parts) else F.array(F.lit(1))
    part = F.pmod(F.xxhash64("vec_id", "x"), F.get(table, F.col("pivot"))).cast("int")
    return placed.select("vec_id", "label", "x", "pivot", part.alias("part")), Pivots(centres, radius, parts, norm)


_TREE = "ids array<long>, labels array<long>, x array<double>, centre array<long>, radius array<double>, own array<long>, own_at array<long>, children array<long>, child_at array<long>"
_NODES = ["centre", "radius", "own", "own_at", "children", "child_at"]


def _forest(placed: DataFrame, dim: int, norm: float, p: Mining) -> DataFrame:
    """One row for every block: its rows and its tree."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        x = as_matrix(table.column("x").combine_chunks(), dim)
        t = cover_tree(augmented(x, norm), norm, p)
        lists = [table.column("vec_id").to_numpy(), table.column("label").to_numpy(), x.ravel(), t.centre, t.radius, t.rows, t.row_at, t.children, t.child_at]
        kinds = [pa.float64() if k in (2, 4) else pa.int64() for k in range(len(lists))]
        values = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32())]
        return pa.table(values + [pa.array([v], pa.list_(k)) for v, k in zip(lists, kinds)], names=["pivot", "part", "ids", "labels", "x", *_NODES])

    return placed.groupBy("pivot", "part").applyInArrow(build, f"pivot int, part int, {_TREE}")


_REQUEST = "key long, anchor_id long, label long, x array<double>, home int, unit int, lows array<double>, highs array<double>, pivot int, part int"


def _routed(requests: DataFrame, top: Pivots, dim: int, home: bool) -> DataFrame:
    """``requests`` once for each block to visit: those of the own pivot, or the others that bounds allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = as_matrix(batch.column(3), dim)
            own = batch.column(4).to_numpy()[:, None] == np.arange(len(top.radius))
            if home:
                visits = own
            else:
                low, high = bounds(q @ top.centres[:, :dim].T, np.sqrt((q * q).sum(1)), top.radius, top.norm)
                width = len(batch.column(6)[0])
                lows, highs = (np.asarray(batch.column(k).flatten()).reshape(-1, 1, width) for k in (6, 7))
                visits = ~own & ((high[:, :, None] >= lows) & (low[:, :, None] <= highs)).any(2)
            row, pivot = np.nonzero(visits)
            row, pivot = np.repeat(row, top.parts[pivot]), np.repeat(pivot, top.parts[pivot])
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (pivot[1:] != pivot[:-1])
            part = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
            for k in range(0, len(row), 10_000):
                some = slice(k, k + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(row[some])).columns, pa.array(pivot[some].astype(np.int32)), pa.array(part[some].astype(np.int32))],
                    names=[f.split()[0] for f in _REQUEST.split(", ")],
                )

    return requests.mapInArrow(run, _REQUEST)


def _visit(requests: DataFrame, forest: DataFrame, units: int, dim: int, norm: float, same: bool, k: int) -> DataFrame:
    """(key, anchor_id, slot, id, score): the first ``k`` of every anchor and window in every block it visits."""

    def run(key: tuple, asked: pa.Table, trees: pa.Table) -> pa.Table:
        names = ["key", "anchor_id", "slot", "id", "score"]
        if not asked.num_rows or not trees.num_rows:
            return pa.table([pa.array([], pa.int32() if c == "slot" else pa.int64()) for c in names], names=names)
        tree = {c: trees.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "labels", "x", *_NODES)}
        lists = {c: asked.column(c).combine_chunks() for c in ("x", "lows", "highs")}
        windows = [np.asarray(lists[c].flatten()).reshape(asked.num_rows, -1) for c in ("lows", "highs")]
        best = Best(*windows, k)
        own = {c: asked.column(c).to_numpy() for c in ("key", "anchor_id", "label")}
        nodes = Tree(*[tree[c] for c in _NODES])
        search(nodes, tree["x"].reshape(-1, dim), tree["ids"], tree["labels"], norm, as_matrix(lists["x"], dim), own["anchor_id"], own["label"], same, best)
        a, w, place = np.nonzero(np.isfinite(best.scores))
        columns = [own["key"][a], own["anchor_id"][a], w.astype(np.int32), best.ids[a, w, place], best.scores[a, w, place].astype(np.int64)]
        return pa.table([pa.array(c) for c in columns], names=names)

    each = forest.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1))))
    by = ["pivot", "part", "unit"]
    return requests.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(run, "key long, anchor_id long, slot int, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every anchor and window, with ``rank`` from 1."""
    order = Window.partitionBy("anchor_id", "key", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(requests: DataFrame, forest: DataFrame, top: Pivots, units: int, dim: int, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows in each window of ``requests``: the own pivot's blocks, then all that may hold better ones."""
    visit = lambda r, home: _visit(_routed(r, top, dim, home), forest, units, dim, top.norm, same, k)
    near = keep(_first(visit(requests, True), k).drop("rank"))
    full = near.groupBy("anchor_id", "key", "slot").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    floors = full.groupBy("anchor_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("floor").cast("double")))).alias("floors"))
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("floors", w), low)))
    rest = requests.join(floors, ["anchor_id", "key"], "left").withColumn("lows", raised)
    far = visit(rest.select(requests.columns), False)
    return keep(_first(near.unionByName(far), k))


def hard_negatives(
    vectors: DataFrame, anchor: Column, p: Mining = Mining(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``anchor`` holds.

    Scores are inner products of whole-number vectors, higher first, ties by smaller id; ids and labels are
    whole numbers. No part is taken by rows with a null id, label or vector, with a null or non-finite entry, of
    another length than the commonest (the longest of those, in a tie), empty, or longer than 2^26 after scaling.
    Rows that repeat id, label and vector count once; other rows that share an id count each, as anchors too, but
    are never positives of one another. A positive with a negative score, or no row in its window, has no rows. Other
    columns are ignored; an empty table gives an empty result.
    """
    x = whole_entries(vectors[vector], p.scale)
    made = vectors.select(
        vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("long").alias("label"), x.alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("vec_id is not null and label is not null and x is not null and size(x) > 0")
    length = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    rows = keep(made.where(length <= LONGEST**2).groupBy("vec_id", "label", "x").agg(F.max("anchor").alias("anchor")))
    dim = commonest_length(rows)
    rows = rows.where(F.size("x") == dim)
    chosen = rows.where("anchor").select("vec_id", "label", "x")
    placed, top = _placed(rows.select("vec_id", "label", "x"), dim, p)
    units = max(1, -(-chosen.count() // p.unit_anchors))
    forest = keep(_forest(placed, dim, top.norm, p))
    asked = placed.join(chosen, ["vec_id", "label", "x"], "left_semi").select(
        F.xxhash64("label", "x").alias("key"), F.col("vec_id").alias("anchor_id"), "label", "x", F.col("pivot").alias("home"),
        F.pmod(F.xxhash64("x", "vec_id"), F.lit(units)).cast("int").alias("unit"),
    )
    asked = keep(asked)
    ends = [F.array(F.lit(float(s))).alias(c) for s, c in (("-inf", "lows"), ("inf", "highs"))]
    positives = _searched(asked.select("*", *ends), forest, top, units, dim, True, p.positives)
    low = F.expr(f"({p.low_percent} * score + 99) div 100").cast("double").alias("low")
    high = F.expr(f"{p.high_percent} * score div 100").cast("double").alias("high")
    windows = positives.where("score >= 0").select("anchor_id", "key", F.struct(F.col("rank"), low, high).alias("w"))
    listed = F.array_sort(F.collect_list("w"))
    # one window for every possible positive; a missing one is empty
    slot = lambda field, gap: F.array(*[F.coalesce(F.get("w", F.lit(k))[field], F.lit(gap)) for k in range(p.positives)])
    windows = windows.groupBy("anchor_id", "key").agg(listed.alias("w"))
    windows = windows.select("anchor_id", "key", slot("low", float("inf")).alias("lows"), slot("high", float("-inf")).alias("highs"))
    requests = keep(asked.join(windows, ["anchor_id", "key"]).select(*asked.columns, "lows", "highs"))
    negatives = _searched(requests, forest, top, units, dim, False, p.negatives)
    named = positives.select("anchor_id", "key", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("anchor_id", "key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(named, ["anchor_id", "key", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negative_digest(vectors: DataFrame, p: Mining = Mining()) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7 the label moves on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, p)


def hard_negative_sql(p: Mining = Mining()) -> str:
    """The same result in DuckDB SQL over ``embeddings``, every anchor against every row."""
    return f"""WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor({p.scale} * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {p.positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id,
       positive_score, n.score AS negative_score
FROM positives JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND {p.low_percent} * positive_score <= 100 * n.score AND 100 * n.score <= {p.high_percent} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= {p.negatives}"""
