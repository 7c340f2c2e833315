from __future__ import annotations

import re
from collections import Counter

import numpy as np

from pathpulse.llm.language import Profiles, languages
from pathpulse.llm.rules import quality_rules

RULES = "doc_id long, text string, lang string, source string, n_words string"


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = Counter(runs)
    repeat = {k for i, r in enumerate(runs) if counts[r] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat),
    )


def test_measures_and_verdicts(spark):
    clean = [" ".join(f"word{(k * 7 + j * 13) % 97}" for j in range(30)) for k in range(300)]
    rows = [(k, t, "en", "s") for k, t in enumerate(clean)]
    rows += [
        (1000, None, None, None), (1001, "", "en", None), (1002, "é ü " * 40, "xx", "s"), (1003, "a # b" * 30, "en", "s"),
        (1004, clean[0] + " %%% $$$ ###", "en", "s"), (1005, "line one\nline one\n\n \nline one", "de", ""),
        (1006, "extraordinarily " * 3 + " ".join(f"incomprehensibilities{j}" for j in range(40)), "en", "s"), (None, clean[1], "en", "s"), (5, clean[5], "en", "s"),
    ]
    got = quality_rules(spark.createDataFrame([(*r, "x") for r in rows], RULES)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        n = measures(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[k] for k in range(300)) and not kept[1004] and not kept[1006] and not kept[1000]
    assert quality_rules(spark.createDataFrame([], RULES)).collect() == []


def test_languages_of_held_out_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_and_nothing_learned(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (None, "the cat", "fr"), (4, "le chat", None), (4, "le chat", None)]
    got = languages(spark.createDataFrame([(*r, "x") for r in rows], schema), Profiles(size=256)).collect()
    found = {(r.doc_id, r.lang_pred, r.score) for r in got}
    assert len(got) == 6 and {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= found
    assert all(r.held_out for r in got if r.doc_id is None)
    assert languages(spark.createDataFrame([], schema)).collect() == []
