from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pathpulse.llm.minhash import MinHash, near_duplicates, overlaps
from pathpulse.llm.store import _smaller, components, keep, settled
from pathpulse.session import ensure_checkpoint_dir

SCHEMA = "doc_id long, text string, rep long, key string, family int, n_shingles string"


def brute(rows, size, percent=80):
    """component_id by doc_id from all pairs."""
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append((doc, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}))
    parent = {doc: doc for doc, _ in sets if doc is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return [(doc, len(s), find(doc) if doc is not None else None) for doc, s in sets]


def corpus(seed):
    rng = random.Random(seed)
    rows, words = [], [f"w{k}" for k in range(60)]
    for family in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            text = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.06]) else w for w in base]
            rows.append(" ".join(text))
    rows += ["", "one", "ONE", "two words", None, "two  words\n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("p", [MinHash(shingle=2), MinHash(shingle=5), MinHash(shingle=2, bucket_block=3, family_block=4, most_broadcast=0)])
def test_components_are_those_of_all_pairs(spark, p):
    rows = corpus(p.shingle) + [(None, "one"), (0, "repeated id with a text of its own")]
    docs = spark.createDataFrame([(*r, 1, "k", 2, "x") for r in rows], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, p).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, p.shingle), key=str)


def test_kept_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b c"), (1, "a b c"), (2, ""), (4, None), (None, "a b c")], "doc_id long, text string")
    rows = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert rows == {3: (1, False), 1: (1, True), 2: (2, True), 4: (4, True), None: (None, True)}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (101, 100)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_overlaps_count_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, n)).astype(np.uint64) for n in (0, 1, 20, 30, 39)]
    assert overlaps(sets).tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


def test_ids_of_text(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "x y z u v w"), (None, "x y z u v w"), ("d", None)]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"b": ("a", False), "a": ("a", True), "c": ("c", True), "d": ("d", True), None: (None, True)}


def test_a_hub_of_many_forests_shrinks_at_once(spark):
    rng = np.random.default_rng(3)
    edges = [(u, int(v)) for u in range(60, 1500) for v in rng.choice(60, 12, replace=False)]
    table = spark.createDataFrame(edges, "u long, v long")
    assert _smaller(table).count() < 1440 + 60 * 60
    found = {r.node: r.root for r in components(table.toDF("a", "b")).collect()}
    assert found == {k: 0 for k in range(1, 1500)}


def test_a_settled_table_leaves_nothing_else(spark):
    import os

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = settled(spark, lambda: keep(keep(spark.range(9)).where("id > 3")).selectExpr("id * 2 AS id"))
    assert sorted(r.id for r in out.collect()) == [8, 10, 12, 14, 16] and len(set(os.listdir(folder)) - before) == 1
    with pytest.raises(ZeroDivisionError):
        settled(spark, lambda: keep(spark.range(5)).where(str(1 / 0)))
    assert len(set(os.listdir(folder)) - before) == 1
