from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pathpulse.llm.personal import Field, Graph, SkipChain, base_spans, luhn, marginals, personal_data
from pathpulse.llm.pitman_yor import PitmanYor, language_scores, seat
from pathpulse.llm.quality import quality_scores

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_quality_of_held_out_texts(spark, small):
    folder = small.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_quality_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", 0.1), (2, None, 0.1), (None, "", 0.1), (1, "a b", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert [r.score for r in quality_scores(docs, labels).collect()] == [0.5] * 4
    assert quality_scores(docs.limit(0), labels.limit(0)).collect() == []


def brute_scores(rows):
    def tokens(text):
        return (text or "").encode().lower().split() + [None]

    counts = Counter()
    for doc, text in rows:
        if doc is not None and zlib.crc32(str(doc).encode()) % 10:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((doc, len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("p", [PitmanYor(), PitmanYor(block_bytes=4000), PitmanYor(block_bytes=4000, hot_words=5)])
def test_base_scores_and_a_better_model(spark, p):
    rng = random.Random(1)
    follow = {f"w{k}": [f"w{rng.randrange(200)}" for _ in range(3)] for k in range(200)}
    rows = []
    for doc in range(400):
        w = [f"w{rng.randrange(200)}"]
        while rng.random() < 0.97:
            w.append(rng.choice(follow[w[-1]]))
        rows.append((doc, " ".join(w).upper() if doc % 3 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (None, "w1 w2"), (7, rows[7][1]), (1002, "unseen word"), (1003, " \n")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    got = language_scores(docs, p).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute_scores(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9
    assert all(r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


class Restaurants:
    """Sequential Gibbs sampling, one customer at a time, with the sizes of all tables."""

    def __init__(self, pairs, discount, parent_discount, strength, words):
        self.d, self.pd, self.strength, self.base = discount, parent_discount, strength, 1 / (words + 1)
        self.rng, self.tables, self.above = random.Random(3), {}, {}
        self.customers = list(pairs)
        for pair in self.customers:
            self.sit(*pair)

    def parent(self, word):
        every = [n for sizes in self.above.values() for n in sizes]
        own = self.above.get(word, [])
        back = (self.strength + self.pd * len(every)) * self.base
        return (sum(own) - self.pd * len(own) + back) / (self.strength + sum(every))

    def chance(self, context, word):
        here = self.tables.get(context, {})
        every = [n for sizes in here.values() for n in sizes]
        own = here.get(word, [])
        back = (self.strength + self.d * len(every)) * self.parent(word)
        return (sum(own) - self.d * len(own) + back) / (self.strength + sum(every))

    def _seat(self, sizes, discount, new):
        x = self.rng.random() * (sum(sizes) - discount * len(sizes) + new)
        for k, n in enumerate(sizes):
            x -= n - discount
            if x < 0:
                sizes[k] += 1
                return False
        sizes.append(1)
        return True

    def _leave(self, sizes):
        k = self.rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    def sit(self, context, word):
        here = self.tables.setdefault(context, {})
        every = sum(len(sizes) for sizes in here.values())
        if self._seat(here.setdefault(word, []), self.d, (self.strength + self.d * every) * self.parent(word)):
            every = sum(len(sizes) for sizes in self.above.values())
            self._seat(self.above.setdefault(word, []), self.pd, (self.strength + self.pd * every) * self.base)

    def sweep(self):
        for context, word in self.customers:
            if self._leave(self.tables[context][word]):
                self._leave(self.above[word])
            self.sit(context, word)


@pytest.mark.parametrize("p", [
    PitmanYor(sweeps=8, samples=5), PitmanYor(sweeps=8, samples=5, block_bytes=150, hot_words=2), PitmanYor(sweeps=8, samples=5, block_bytes=300),
])
def test_scores_near_those_of_sequential_gibbs_sampling(spark, p):
    rng = random.Random(5)
    rows = []
    for doc in range(60):
        w = ["a"]
        while rng.random() < 0.9:
            w.append(rng.choice({"a": "bbbc", "b": "acd", "c": "aaaaf", "d": "eg"}.get(w[-1], "abcdefgh")))
        rows.append((doc, " ".join(w)))
    pairs = {doc: list(zip([None, *text.split()], [*text.split(), ""])) for doc, text in rows}
    learned = [x for doc in pairs if zlib.crc32(str(doc).encode()) % 10 for x in pairs[doc]]
    counts, kinds = Counter(learned), Counter(word for _, word in set(learned))
    discount, parent_discount = (
        min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        for ones, twos in ((sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for c in (counts, kinds))
    )
    model = Restaurants(learned, discount, parent_discount, p.strength, len(kinds))
    chances, samples = Counter(), 150
    for sweep in range(samples + 10):
        model.sweep()
        if sweep >= 10:
            for pair in {x for doc in pairs for x in pairs[doc]}:
                chances[pair] += model.chance(*pair) / samples
    want = {doc: sum(math.log10(chances[x]) for x in pairs[doc]) for doc in pairs}
    got = {r.doc_id: r.score for r in language_scores(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert abs(sum(got.values()) - sum(want.values())) < 0.01 * abs(sum(want.values()))
    assert max(abs(got[d] - want[d]) / (1 + abs(want[d])) for d in want) < 0.1


def test_more_contexts_than_any_fixed_table_keep_their_own_followers(spark):
    rng = random.Random(6)
    follow = list(range(3000))
    rng.shuffle(follow)
    rows = []
    for doc in range(600):
        w = [rng.randrange(3000)]
        while len(w) < 60:
            w.append(follow[w[-1]])
        rows.append((doc, " ".join(f"w{x}" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in language_scores(docs, PitmanYor(block_bytes=20000)).collect() if r.held_out]
    # the first word is free and the end unforeseeable; the 59 others follow from the word before
    assert np.mean([r.score for r in held]) > -20 > 0.2 * np.mean([r.base_score for r in held])


def test_model_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert language_scores(docs).collect() == []


def test_tables_grow_as_the_restaurant_says():
    rng = np.random.default_rng(4)
    n = np.full(4000, 60)
    tables = seat(n, np.full(4000, 0.4), np.full(4000, 0.2), 0.5, rng)
    assert tables.min() >= 1 and tables.max() <= 60
    one = []
    for _ in range(4000):
        t = 1
        for k in range(1, 60):
            opened = 0.4 + 0.2 * t
            t += rng.random() < opened / (opened + k - 0.5 * t)
        one.append(t)
    assert abs(tables.mean() - np.mean(one)) < 0.15
    assert seat(np.array([0, 1, 10**6]), np.ones(3), np.ones(3) * 0.1, 0.5, rng)[:2].tolist() == [0, 1]


def searched(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip":
                good = all(int(x) <= 255 for x in m.group().split("."))
            else:
                good = {"email": True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    for _ in range(20000):
        text = "".join(rng.choice("01254+.@-( )ab") for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == searched(text)


def test_field_adds_what_agrees_and_leaves_the_rest(spark, small):
    folder = small.replace("0.001", "0.01")
    extra = [
        (90001, "call 1 (407) 555-7710 or +1 (407) 555-7710 now", "phone:5:21,phone:25:42"),
        (90002, "write jo.98 (at) mail5 (dot) example (dot) com or jo.98@mail5.example.com", "email:6:46,email:50:73"),
        (90003, "on 2024-01-15 and 0810992847249405 and 12345678901234567890", ""), (90004, None, ""), (90005, "", ""), (None, "no", ""),
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    both = docs.unionByName(spark.createDataFrame([r[:2] for r in extra], "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in both.collect()}
    got = personal_data(both).collect()
    spans = {r.doc_id: r.spans for r in got}
    assert [spans[r[0]] for r in extra] == [r[2] for r in extra]
    for r in got:
        base = searched(text[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        counts = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PATTERNS)
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    assert personal_data(both.limit(0)).collect() == []


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8, 60])
def test_all_unmarked_repeats_of_a_find_are_added(spark, small, m):
    folder = small.replace("0.001", "0.01")
    mention = "1 (407) 555-7710"
    text = " then ".join([mention] * m) + " or +1 (407) 555-7710 now"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(90001, text)], "doc_id long, text string")
    )
    spans = next(r.spans for r in personal_data(docs).collect() if r.doc_id == 90001).split(",")
    places = [k * (len(mention) + 6) for k in range(m)]
    assert spans == [f"phone:{a}:{a + len(mention)}" for a in places] + [f"phone:{len(text) - 21}:{len(text) - 4}"]


def test_marginals_equal_enumeration_on_trees_and_settle_on_loops():
    rng = np.random.default_rng(4)
    pair = [np.log(rng.random((5, 5)) + 0.1) for _ in range(2)]
    chain, skip = (x + x.T for x in pair)
    weights = rng.normal(size=(3, 5))
    model = Field({(0, "s"): 1, (0, "t"): 2}, weights, chain, skip)
    for edges, loop in ((([(0, 1), (1, 2)], [(2, 3)]), False), (([(0, 1), (1, 2), (2, 3)], [(0, 3)]), True)):
        graph = Graph([(0, k, k, 2 if k == 3 else 0, "st"[k % 2]) for k in range(4)], *edges)
        unary = model.unary([n[4] for n in graph.nodes])
        want = np.zeros((4, 5))
        for labels in itertools.product(range(5), repeat=4):
            if labels[3] == 2:
                total = sum(unary[k, x] for k, x in enumerate(labels))
                total += sum(chain[labels[a], labels[b]] for a, b in edges[0]) + sum(skip[labels[a], labels[b]] for a, b in edges[1])
                for k, x in enumerate(labels):
                    want[k, x] += np.exp(total)
        want /= want.sum(axis=1, keepdims=True)
        got = marginals(model, graph, SkipChain(tolerance=1e-10))
        # the found node is fixed, which opens this loop
        assert np.abs(got - want).max() < 1e-6, loop
