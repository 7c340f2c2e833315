"""Byte-level pre-tokens of texts, found for a whole slice at a time.

The rule is that of the vocabulary file's own pre-tokenizer: contractions, letters, numbers and other
signs, each with one blank before, and white space that leaves its last blank to the next piece. The
strings of added tokens are cut out first, as the library does by default.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

import numpy as np
from tokenizers.pre_tokenizers import ByteLevel

from pathpulse.llm.words import Text, mix, span_hashes

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
# Code points that are white space, and the endings that an apostrophe splits off.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT, _LONG = "stmd", ("re", "ve", "ll")


@cache
def _classes() -> np.ndarray:
    """Class of every code point, read off the runs in which the library's splitter keeps neighbours together."""
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    codes = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    out = np.full(0x110000, _OTHER, np.uint8)
    for _, (a, b) in split("".join(map(chr, codes.tolist()))):
        last = chr(codes[b - 1])
        out[codes[a:b]] = next((k for k, x in ((_LETTER, "a"), (_NUMBER, "1")) if len(split(x + last)) == 1), _OTHER)
    out[_WHITE] = _SPACE
    return out


@dataclass
class Pieces:
    """Distinct pieces of some texts and their order: text k has the pieces order[of[k]:of[k + 1]]."""

    distinct: list[str]
    order: np.ndarray
    of: np.ndarray


def pieces(text: Text, added: tuple[str, ...] = ()) -> Pieces:
    """Pre-tokens of every text; strings of ``added`` are pieces of their own."""
    raw = text.data.tobytes()
    whole = raw.decode("utf-8")
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(codes)
    leads = np.concatenate(([0], np.cumsum((text.data & 0xC0) != 0x80)))
    at = leads[text.at]
    if not n:
        return Pieces([], np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    fixed = []
    for token in added:
        found = whole.find(token)
        while found >= 0:
            if not edge[found + 1 : found + len(token)].any():
                fixed.append((found, found + len(token)))
            found = whole.find(token, found + len(token))
    for a, b in fixed:
        edge[[a, b]] = True
    kind = _classes()[codes]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    blank = (kind[runs] == _SPACE) & ~edge[ends]
    last = ends[blank] - 1
    start[last] = True
    start[ends[blank][codes[last] == 32]] = False
    _contractions(codes, kind, edge, start)
    for a, b in fixed:
        start[a + 1 : b] = False
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    hashes = span_hashes(lambda a, b: mix(codes[a:b] + np.uint64(0x5851F42D)), starts, ends)
    _, first, order = np.unique(hashes, return_index=True, return_inverse=True)
    found = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    return Pieces(found, order, np.searchsorted(starts, at))


def _contractions(codes: np.ndarray, kind: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
    n = len(codes)
    marks = np.flatnonzero((codes[:-1] == ord("'")) & start[:-1] & ~edge[1:-1] & (kind[1:] == _LETTER))
    for q in marks.tolist():
        one = chr(codes[q + 1])
        two = one + chr(codes[q + 2]) if q + 2 < n and not edge[q + 2] else one
        size = 1 if one in _SHORT else 2 if two in _LONG else 0
        if size:
            start[q + 1] = False
            after = q + 1 + size
            if after < n and kind[after] == _LETTER:
                start[after] = True


@dataclass(frozen=True)
class Vocabulary:
    """What a byte-level merge list needs: symbols of bytes, pair ranks and added strings."""

    bytes_: tuple[int, ...]
    pairs: dict[int, int]
    added: tuple[str, ...]


def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies write for every byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def vocabulary(content: str) -> Vocabulary:
    """Merge ranks of a vocabulary file's JSON text; a pair's entry is rank * 2**20 + its merged id."""
    file = json.loads(content)
    ids = file["model"]["vocab"]
    pairs = {}
    for rank, merge in enumerate(file["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs[ids[left] << 20 | ids[right]] = rank << 20 | ids[left + right]
    added = tuple(t["content"] for t in file["added_tokens"])
    return Vocabulary(tuple(ids[x] for x in byte_letters()), pairs, added)
