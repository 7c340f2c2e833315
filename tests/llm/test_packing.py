from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_tokens import LIBRARY, strange

from pathpulse.llm.packing import Packing, pack

SCHEMA = "doc_id long, source string, text string, task string, start int"


def rows_of(n, seed=1):
    texts = strange(n, seed)
    return [(k, [None, "", "hot", "hot", "hot", "b", "c"][k % 7], t * (1 + k % 9), "t", 0) for k, t in enumerate(texts)]


def verify(rows, pieces, size):
    ids = {r[0]: LIBRARY.encode(r[2] or "", add_special_tokens=False).ids + [0] for r in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for doc, found in by_doc.items():
        ends = np.cumsum([0] + [p.length for p in sorted(found, key=lambda p: p.start)])
        assert [p.start for p in sorted(found, key=lambda p: p.start)] == ends[:-1].tolist() and ends[-1] == len(ids[doc])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for found in by_sequence.values():
        found.sort(key=lambda p: p.offset)
        ends = np.cumsum([0] + [p.length for p in found])
        assert [p.offset for p in found] == ends[:-1].tolist()
        assert ends[-1] == size or (ends[-1] < size and ends[-1] & (ends[-1] - 1) == 0)
    return by_sequence


@pytest.mark.parametrize("p", [Packing(), Packing(size=64, window=96, quantum=10), Packing(size=128, window=128, quantum=1)])
def test_every_token_once_without_padding(spark, p):
    rows = rows_of(700)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = verify(rows, pack(docs, p, with_ids=True).collect(), p.size)
    assert all(len(x.ids) == x.length for s in found.values() for x in s)


def test_deficits_stay_below_a_quantum(spark):
    rows = rows_of(2000, 4)
    p = Packing(size=64, window=64, quantum=16)
    found = verify(rows, pack(spark.createDataFrame(rows, SCHEMA).repartition(5), p).collect(), p.size)
    total = Counter()
    for s in found.values():
        total.update({x.source: 0 for x in s})
        for x in s:
            total[x.source] += x.length
    seen = Counter()
    for k in sorted(found):
        for x in found[k]:
            seen[x.source] += x.length
        n = sum(seen.values())
        assert max(abs(seen[s] - n * total[s] / sum(total.values())) for s in total) <= p.quantum + p.window


def test_targets_hold_until_a_source_runs_dry(spark):
    rows = [(k, "ab"[k % 2], "word " * 200, "t", 0) for k in range(60)]
    p = Packing(size=64, window=64, quantum=4)
    found = verify(rows, pack(spark.createDataFrame(rows, SCHEMA), p, {"a": 3, "b": 1}).collect(), p.size)
    half = [x for k in sorted(found)[: len(found) // 2] for x in found[k]]
    share = sum(x.length for x in half if x.source == "a") / sum(x.length for x in half)
    assert abs(share - 0.75) < 0.02


def test_null_texts_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "", 0), (2, "s", "", "", 0), (2, "s", "", "", 0), (None, "s", "a", "", 0)], SCHEMA)
    got = pack(docs).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == {None: 2, 1: 1, 2: 2} and sorted(r.sequence_id for r in got)[-1] == 1
    assert pack(docs.limit(0)).collect() == []
