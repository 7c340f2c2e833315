from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from pathpulse.llm.words import distinct, shingles, texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = ["a b  a", None, "", " \t\n", "Ab ab AB aB", "x" * 3000, "é è ü\x0bz", "a b a b a b", "end"]


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_are_those_of_the_pattern(limit, kind):
    column = pa.concat_arrays([pa.array(["skipped"], kind), pa.array(ROWS, kind)]).slice(1)
    ids: dict = {}
    seen: dict = {}
    k = 0
    for part in texts(column, limit):
        w = words(part)
        for t in range(len(part)):
            want = WORD.findall(ROWS[k] or "")
            got = w.hashes[w.of[t] : w.of[t + 1]].tolist()
            assert len(got) == len(want)
            for h, x in zip(got, want):
                assert ids.setdefault(x, h) == h and seen.setdefault(h, x) == x
            k += 1
    assert k == len(ROWS)


def test_folding_takes_only_ascii_letters():
    (part,) = texts(pa.array(["AbZ abz É é"]))
    h = words(part, fold=True).hashes
    assert h[0] == h[1] and h[2] != h[3]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingles_and_their_distinct_sets(size):
    (part,) = texts(pa.array(ROWS))
    hashes, of = shingles(words(part), size)
    sets, at = distinct(hashes.copy(), of)
    for k, text in enumerate(ROWS):
        w = WORD.findall(text or "")
        want = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] * bool(w)
        assert of[k + 1] - of[k] == len(want)
        assert at[k + 1] - at[k] == len(set(want))
    assert np.all(np.diff(at) >= 0)
