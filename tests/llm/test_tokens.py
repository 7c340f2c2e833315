from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pathpulse.llm.tokens import count_merged, token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABET = [*"abstmdrevl'' \n\t  12.,;!?éßñ漢字 　​٣½Ⅷ😀\x85\r\x0b<|>", "<|endoftext|>", "'ll", "'s", " '", "  "]


def strange(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_are_the_librarys(spark, small):
    rows = [(k, t, "n") for k, t in enumerate([*strange(4000), None, "", "a" * 5000, "<|endoftext|>" * 3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    docs = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 100000 AS doc_id", "text", "lang AS n_tokens"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = token_counts(docs).collect()
    assert len(got) == len(text)
    for r in got:
        n = len(LIBRARY.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 1024)


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "x")], "doc_id int, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs).collect()) == [(0, 1), (1, 2), (1, 2)]
    assert token_counts(docs.limit(0)).collect() == []


@pytest.mark.parametrize("symbols, left", [([], 0), ([1], 1), ([1, 1, 1], 2), ([1, 2, 1, 2], 1), ([2, 1, 1, 2], 3)])
def test_lowest_rank_merges_first(symbols, left):
    pairs = {1 << 20 | 2: 0 << 20 | 3, 1 << 20 | 1: 1 << 20 | 4, 3 << 20 | 3: 2 << 20 | 5}
    assert count_merged(list(symbols), pairs) == left
