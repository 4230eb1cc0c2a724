"""Byte-level text helpers and the piece tokenizer, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ticketlab.llm import bytetext as B
from ticketlab.llm import tokens as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "One two  THREE\tfour\nfive", " lead and trail ", "é È ñ 中文 x", "a", " hard spaces\x1cin words", "x" * 5000, "last one"]


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("size", [1, 20, 1 << 20])
def test_words_and_hashes(size):
    hashes, texts = {}, 0
    for s in B.slices(pa.array(TEXTS), size):
        w = B.words(s)
        for i in range(len(s.offsets) - 1):
            text = TEXTS[s.first + i]
            own = [bytes(s.data[a:z]).decode() for a, z in zip(w.starts[w.first[i]:w.first[i + 1]], w.ends[w.first[i]:w.first[i + 1]])]
            assert own == WORD.findall(text or "")
            for word, h in zip(words_of(text), w.hashes[w.first[i]:w.first[i + 1]].tolist()):
                assert hashes.setdefault(word, h) == h
            texts += 1
    assert texts == len(TEXTS) and len(set(hashes.values())) == len(hashes)


def test_slices_of_a_sliced_column():
    part = pa.array(TEXTS).slice(2, 3)
    got = [bytes(s.data[a:z]).decode() for s in B.slices(part, 10) for a, z in zip(s.offsets[:-1], s.offsets[1:])]
    assert got == TEXTS[2:5]


def test_per_text_with_empty_texts():
    assert B.per_text(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]


def test_ids_equal_the_tokenizers():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "É", "×", "ÿ", "Ÿ", "ß", "'s", "'", ".", ",", "!!", "<", "<|endoftext|>", "<|ENDOFTEXT|>", "7", "42", "́", "中", "ǅ", "İ", "ς", " ", "\n",
                " ", "\x1c", "\x85", "-", "|", "ing", "the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)] + TEXTS + ["it's 3.5kg, DON'T", "a" * 300 + "." * 200]
    ids_of = T.piece_ids(T.default_path())
    for s in B.slices(pa.array(texts), 2000):
        ids, first = ids_of.slice(s)
        for i in range(len(s.offsets) - 1):
            want = ids_of.tokenizer.encode(texts[s.first + i] or "", add_special_tokens=False).ids
            assert ids[first[i]:first[i + 1]].tolist() == want, texts[s.first + i]


def test_distinct_is_unique_in_order_of_appearance():
    x = np.random.default_rng(2).integers(0, 50, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for v in (x, x[:1], x[:0]):
        values, first, place = B.distinct(v)
        assert np.array_equal(values[place], v) and np.array_equal(v[first], values) and sorted(first.tolist()) == first.tolist()
        assert np.array_equal(np.sort(values), np.unique(v))
