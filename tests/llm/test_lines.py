from __future__ import annotations

import random
import re

import pytest

from pathpulse.llm import lines as line_operators
from pathpulse.llm.lines import LineDedup, matched_lines, without_matched_lines


def brute(rows, percent=80, least=1):
    lines = []
    for doc, text in rows:
        if doc is not None and text is not None:
            for k, line in enumerate(text.split("\n")):
                tokens = set(re.findall(r"[^\x20\x09-\x0D]+", line))
                if len(tokens) >= least:
                    lines.append(((doc, k), tokens))
    gone = set()
    for at, x in lines:
        for other, y in lines:
            if other < at and 100 * len(x & y) >= percent * len(x | y):
                gone.add(at)
    return gone


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.expovariate(0.02)), 500)}" for _ in range(900)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 70))] for _ in range(14)]
    rows = []
    for doc in range(90):
        lines = []
        for _ in range(rng.randint(0, 6)):
            base = rng.choice(bases)
            rate = rng.choice([0, 0, 0.05, 0.1, 0.2])
            lines.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in base))
        rows.append((doc, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("p", [LineDedup(), LineDedup(buckets=4, most_broadcast=0), LineDedup(percent=60, least_tokens=2), LineDedup(least_tokens=5)])
def test_removes_what_all_pairs_remove(spark, p):
    rows = corpus(p.percent) + [(500, None), (501, ""), (502, "\n\n"), (None, "a b c d e f"), (503, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in matched_lines(docs, p).collect()}
    want = brute(rows, p.percent, p.least_tokens)
    assert got == want and len(want) > 30


def test_texts_and_other_columns(spark):
    rows = [(1, "a b c d e\nx\na b c d e f", 7), (2, "a b c d e\n q r s t u\nx", 8), (3, None, 9), (None, "a b c d e", 1), (4, "", 2), (4, "", 3)]
    got = without_matched_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int")).collect()
    assert sorted((r.doc_id or 0, r.text or "-", r.n_lines, r.n_removed) for r in got) == [
        (0, "a b c d e", 1, 0), (1, "a b c d e\nx", 3, 1), (2, " q r s t u", 3, 2), (3, "-", 0, 0), (4, "-", 1, 0), (4, "-", 1, 0),
    ]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert without_matched_lines(empty).collect() == []


def test_ids_that_do_not_pack_and_ids_of_text(spark):
    rows = [(k * (1 << 55) - (1 << 62), t) for k, t in corpus(3)]
    for kind, name in (("long", int), ("string", lambda k: f"d{k + (1 << 62):020d}")):
        given = [(name(k), t) for k, t in rows]
        got = {tuple(r) for r in matched_lines(spark.createDataFrame(given, f"doc_id {kind}, text string")).collect()}
        assert got == brute(given)


def test_short_lines_and_lines_without_blanks(spark):
    rows = [(1, "All rights reserved.\n\nyes\n一个没有空格的句子"), (2, "yes\nAll rights reserved.\n \nno"), (3, "一个没有空格的句子\nb a"), (4, "a b\na b c d\na b c d e")]
    got = {r.doc_id: r.text for r in without_matched_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\n \nno"[1:], 3: "b a", 4: "a b c d"}


def test_many_equal_lines_of_one_text(spark):
    text = "\n".join(["one two three", "", "four"] * 40_000)
    row = without_matched_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_removed == 79_998 and row.text.replace("\n", "") == "one two threefour" and row.n_lines == 120_000


def test_lines_just_below_the_limit_make_few_pairs(spark, monkeypatch):
    """Variants of one line that share too few tokens by a little are told apart before their pairs are made."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for doc in range(160):
        at = set(rng.sample(range(60), 5))
        rows.append((doc, " ".join(f"v{doc}_{k}" if k in at else w for k, w in enumerate(base))))
    rows += [(160, rows[3][1] + " more"), (161, " ".join(rows[9][1].split()[2:]))]
    made, plain = [], line_operators._joined_pairs

    def counted(*given):
        pairs = plain(*given)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_operators, "_joined_pairs", counted)
    got = {tuple(r) for r in matched_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and {(160, 0), (161, 0)} <= got
    assert made[0] < 1_000  # of 12,880


def test_rest_bitmaps_count_no_common_token_as_different(spark):
    """At the first common token two bitmaps of the rest differ in no more bits than the sets differ in tokens."""
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(1 << 40), 4) + rng.sample(range(400), rng.randint(60, 150))) for _ in range(40)]
    rows = [(k, s, s[:30]) for k, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "id long, tokens array<long>, prefix array<long>")
    table = table.withColumns({"bits": line_operators._bitmap("tokens"), "half": line_operators._bitmap(line_operators.F.filter("tokens", line_operators._half))})
    rests = line_operators._rests
    found = {r["id"]: (r["r"], r["h"]) for r in table.select("id", rests("bits").alias("r"), rests("half", line_operators._half).alias("h")).collect()}
    for a in range(40):
        for i in range(30):
            whole = half = 0
            for x in sets[a][i:]:
                bit = 1 << (x & 63)
                whole, half = whole ^ bit, half ^ (bit if x & 64 else 0)
            assert found[a][0][i] % (1 << 64) == whole and found[a][1][i] % (1 << 64) == half
