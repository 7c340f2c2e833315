from __future__ import annotations

import random
import re

from pathpulse.llm.decontaminate import Decontamination, contaminated, decontaminated


def brute(docs, items):
    def split(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())

    out = set()
    for doc, text in docs:
        t = split(text)
        for item, it in items:
            b = split(it)
            size, wrong = min(13, len(b)), 2 if len(b) >= 13 else 1
            if 0 < len(b) < 8:
                if t == b:
                    out.add((doc, item))
            elif b and any(
                sum(x != y for x, y in zip(t[i : i + size], b[j : j + size])) <= wrong
                for i in range(len(t) - size + 1)
                for j in range(len(b) - size + 1)
            ):
                out.add((doc, item))
    return out


def cases():
    rng = random.Random(2)
    word = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(word) for _ in range(n))) for k, n in enumerate([5, 8, 10, 12, 13, 14, 20, 40, 60, 8, 13])]
    items += [(20, None), (21, ""), (22, "  ")]
    docs = []
    for k in range(260):
        text = [rng.choice(word) for _ in range(rng.randint(0, 60))]
        part = items[rng.randrange(11)][1].split()
        size = rng.randint(min(len(part), 5), len(part))
        at = rng.randint(0, len(part) - size)
        part = [rng.choice(word) if rng.random() < rng.choice([0, 0.1, 0.15]) else w for w in part[at : at + size]]
        place = rng.randint(0, len(text))
        docs.append((k, " ".join(text[:place] + [w.upper() if rng.random() < 0.2 else w for w in part] + text[place:])))
    return docs + [(900, None), (901, ""), (902, items[0][1]), (903, items[0][1] + " more")], items


def test_overlaps_are_those_of_all_windows(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 50
    for p in (Decontamination(), Decontamination(block_bytes=300)):
        got = contaminated(d, b, p).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(0 <= r.doc_start < r.doc_end and r.matched <= r.doc_end - r.doc_start for r in got)
    clean = decontaminated(d, b)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, _ in docs} - {k for k, _ in want}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
    assert decontaminated(d, b.limit(0)).count() == 1 and decontaminated(d, b).count() == 0
