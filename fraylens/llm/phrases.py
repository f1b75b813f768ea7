"""Substring dedup of words by repeated-phrase automata.

``repeats`` finds the passages of all documents that may recur and deals them
into shards. A shard confirms which passages do recur, whole or in windows of 20
words, compiles these phrases into Aho-Corasick automata (one character a word)
and streams its own passages through them, batch by batch. The anchors find the
occurrences; the automata only tell which windows of the passages are equal. No
whole document is streamed. The earliest occurrence of a phrase stays.

A null text has no words; the other cases are those of ``repeats``.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from fraylens.llm.repeats import BYTE_HASH, HOT, Scheme, Units, mixed, removed

WIDTH, GRAM = 20, 5
_ODD = np.uint64(0xA24BAED4963EE407)


def _units(texts: list[bytes]) -> Units:
    split = [t.split() for t in texts]
    bounds = np.cumsum([0, *map(len, split)])
    words = [w for s in split for w in s]
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    if not words:
        return Units(b"", begins, ends, np.zeros(0, np.uint64), bounds)
    # A word's hash: its byte hashes weighted by powers of their place in the word.
    nth = np.arange(len(data)) - np.repeat(begins, np.append(sizes[:-1] + 1, sizes[-1]))
    weight = _word_powers(int(sizes.max()) + 1)
    summed = np.add.reduceat(BYTE_HASH[np.frombuffer(data, np.uint8)] * weight[nth], begins)
    gap = BYTE_HASH[32] * weight[sizes[:-1]]  # reduceat took each space in
    summed[:-1] -= gap
    return Units(data, begins, ends, mixed(summed), bounds)


def _word_powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _character(number: int) -> str:
    return chr(number + 1 if number < 0xD7FF else number + 0x801)


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        out.add_word(phrase, i)
    out.make_automaton()
    return out


def _classes(contents: list[bytes], windows: np.ndarray, times: np.ndarray, width: int = WIDTH) -> np.ndarray:
    letters: dict[bytes, str] = {}
    lines = ["".join([letters.get(w) or letters.setdefault(w, _character(len(letters))) for w in c.split(b" ")]) for c in contents]
    # Confirm: a window recurs if several passages hold it, or one passage occurs several times.
    count: Counter = Counter()
    for line, n in zip(lines, times.tolist(), strict=True):
        for i in range(len(line) - width + 1):
            count[line[i : i + width]] += n
    alone = [all(count[line[i : i + width]] == n for i in range(len(line) - width + 1)) for line, n in zip(lines, times.tolist(), strict=True)]
    phrases = [line for line, one, n in zip(lines, alone, times.tolist(), strict=True) if one and n > 1]
    parts = {line[i : i + width] for line, one in zip(lines, alone, strict=True) if not one for i in range(len(line) - width + 1)}
    phrases += sorted(p for p in parts if count[p] > 1)
    out = -1 - np.arange(int(windows.sum()))  # what no phrase matches is a class of its own
    if not phrases:
        return out
    base = np.cumsum([0, *(len(p) - width + 1 for p in phrases)])
    matcher, at = automaton(phrases), 0
    for line, n in zip(lines, windows.tolist(), strict=True):
        for end, i in matcher.iter(line):
            size = len(phrases[i])
            begin = end + 1 - size
            out[at + begin : at + end + 2 - width] = np.arange(base[i], base[i + 1])
        at += n
    return out


def _drop(data: bytes, begins: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    if not len(begins):
        return b""
    if not gone.any():
        return data[begins[0] : ends[-1]]
    stay = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
    return b" ".join([data[begins[a] : ends[b - 1]] for a, b in zip(stay[::2].tolist(), stay[1::2].tolist(), strict=True)])


SCHEME = Scheme(WIDTH, GRAM, _units, _classes, _drop)


def deduplicated(docs: DataFrame, hot: int = HOT, kept: bool = True, **sizes) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept_sha256 and the kept words of every document."""
    return removed(docs, SCHEME, hot, kept=kept, **sizes)
