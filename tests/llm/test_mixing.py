from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from pathpulse.llm.mixing import Mixture, mixed, mixture_digest, source_targets

SCHEMA = "doc_id long, text string, source string"


def reshared(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit >= most * sizes[s]}
        if not full:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def corpus(n, seed, hot=1 / 3):
    rng = random.Random(seed)
    names = ["b", "a", "", "z", None, "é"]
    return [
        (k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))), "hot" if rng.random() < hot else rng.choice(names))
        for k in range(n)
    ]


def check(rows, got, p=Mixture()):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = reshared(sizes, p.weights, p.share, p.most)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r.times * r.size and 0 <= r.times <= p.most
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest[s] / 2 + 1e-6
    return want


@pytest.mark.parametrize("p", [Mixture(), Mixture((1, 7), 0.3, 1), Mixture((5, 1, 1, 1), 2.9, 3)])
def test_shares_reach_their_targets(spark, p):
    rows = corpus(700, 3)
    got = mixed(spark.createDataFrame(rows, SCHEMA), p).collect()
    assert len(got) == len(rows)
    check(rows, got, p)


def test_reruns_and_other_partitions_agree(spark):
    docs = spark.createDataFrame(corpus(500, 4), SCHEMA)
    one = sorted(mixture_digest(docs).collect())
    assert one == sorted(mixture_digest(docs).collect())
    assert one == sorted(mixture_digest(docs.repartition(7, "text").withColumn("doc_id", docs.doc_id)).collect())


def test_mixes_are_nested(spark):
    docs = spark.createDataFrame(corpus(400, 5), SCHEMA)
    small, large = ({r.doc_id: r.times for r in mixed(docs, Mixture((1,), share)).collect()} for share in (0.4, 1.3))
    assert all(small[k] <= large[k] for k in small)


def test_repeated_rows_are_split_by_the_threshold(spark):
    rows = [(None, "a b c", "s")] * 1000 + [(7, "a b c", "t")] * 900 + [(8, None, "t"), (9, "", None), (10, None, None)]
    got = mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = check(rows, got)
    assert 0 < want["t"] % 2700 and {r.times for r in got if r.source == "t" and r.size} == {0, 1}
    assert {r.taken for r in got if r.source is None} == {0}


def test_long_text_clashing_columns_and_empty_table(spark):
    long = "wort " * 300_000
    docs = spark.createDataFrame([(1, long, "a", 5, "x"), (2, "one two", "b", 6, "y")], SCHEMA + ", size int, hash string")
    got = {r.doc_id: r for r in mixed(docs).collect()}
    assert got[1].size == 300_000 and got[1].text == long and got[2].hash == "y" and got[2].target == 4.0
    assert mixed(docs.limit(0)).collect() == []
    assert mixed(spark.createDataFrame([(1, None, None)], SCHEMA)).first().target == 0.0


def test_many_sources_need_no_single_task(spark):
    sizes = {f"s{k:05d}": 1 + k % 97 for k in range(5000)}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = reshared(sizes)
    for r in source_targets(table).collect():
        assert r.target == pytest.approx(want[r.source], rel=1e-9)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Mixture(share=3.0)
