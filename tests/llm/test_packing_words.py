import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from fraylens.llm import packing
from fraylens.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def words():
    return packing._WordIds(tokenizer_path())


def plain(words, texts):
    return [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_of_letters_are_learnt_without_offsets(words, monkeypatch):
    asked = []
    monkeypatch.setattr(words, "_learn", lambda some: asked.extend(some) or packing._WordIds._learn(words, some))
    texts = ["Plain words, ünd größere Wörter\tstraße naïve", "x3 don't  (so)  wide gap 漢字 ж", "", "  ", "Kiel"]
    assert words.of(pa.array([t.encode() for t in texts])) == plain(words, texts)
    assert {text for _, text in asked if text.isalpha()} == set()


def test_letters_that_fall_apart_are_told_by_offsets(words):
    texts = ["İstanbul und İzmir, Ankara", "Bursa \u212a\u212b \ufb01ne"]
    assert words.of(pa.array([t.encode() for t in texts])) == plain(words, texts)


def test_random_words_equal_the_tokenizer(words):
    rng = np.random.default_rng(4)
    parts = [*"abzQÄßéжñ漢ǅ́̌'.,-3", " ", "  ", "\n", "\x0b", "\x1c", " ", "<|", "<|endoftext|>", "ing", "the"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2_000)]
    array = pa.array([t.encode() for t in texts])
    assert list(itertools.chain(words.of(array.slice(7, 900)), words.of(array.slice(907)))) == plain(words, texts[7:])


def test_runs_of_texts_are_bounded_by_their_bytes(monkeypatch):
    monkeypatch.setattr(packing, "_TEXT_BYTES", 10)
    texts = pa.array([b"12345", b"12345", b"1", b"x" * 50, b"", b"12"], pa.binary())
    assert list(packing._few(texts)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert [n for _, n in packing._few(texts.slice(3))] == [1, 2]
    assert pc.binary_length(texts.slice(*next(packing._few(texts)))).to_pylist() == [5, 5]
