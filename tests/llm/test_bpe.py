"""Merge rounds against the tokenizers library, on long words above all."""

import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from marketweave.llm import bpe


@pytest.fixture(scope="module")
def pair():
    return bpe.Tokenizer(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


def ids(own, texts):
    return [[int(i) for i in x.split(",")] if x else [] for x, _, _ in own.encode(texts)]


def test_both_ways_of_merging_agree(pair):
    own, lib = pair
    rng = np.random.default_rng(4)
    words = [
        "".join(rng.choice(list(letters), n)) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "aé語") for n in (1, 2, 3, 17, 90, 400)
    ] + ["a" * k for k in range(1, 40)]
    short, long = own.merge([w.encode() for w in words]), own.merge_long([w.encode() for w in words])
    assert np.array_equal(short[0], long[0]) and np.array_equal(short[1], long[1])
    assert ids(own, words) == [lib.encode(w, add_special_tokens=False).ids for w in words]


def test_very_long_words_take_seconds(pair):
    own, lib = pair
    rng = np.random.default_rng(5)
    texts = [
        "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)),
        "x" * 300_000,
        " " * 50_000 + "\n" * 50_000,
        "".join(rng.choice(list("!?#"), 100_000))
    ]
    began = time.time()
    got = ids(own, texts)
    assert time.time() - began < 40
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any(len(w) > bpe.LONG for w in own.known)  # long words are not remembered


def test_bytes_remembered_are_bounded(pair, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 4000)
    own, lib = bpe.Tokenizer(bpe.default_path()), pair[1]
    texts = [" ".join(f"word{k}x{i}" for i in range(40)) for k in range(3_000)]
    for k in range(0, len(texts), 500):
        assert ids(own, texts[k : k + 500]) == [lib.encode(t, add_special_tokens=False).ids for t in texts[k : k + 500]]
    assert own.held <= 8 * sum(len(w) for w in own.known)
