"""Counts against the tokenizer library itself."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import MESSY, texts_of
from tokenizers import Tokenizer

from assaybook.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def merges():
    return token_counts.ByteMerges(PATH)


def test_fuzz(library, merges):
    random.seed(5)
    letters = " \n\t'stremvld aA9éß中　\xa0.!<|>endoftext\u0558\U000323b0"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(4000)]
    texts += ["a<|endoftext|>  b <|endoftext|>", "<|endoftext|>", "a" * 5000, "ab" * 3000, "é" * 999, " " * 300, "\n\n \n", "don't we'LL '' 's"]
    assert token_counts.TokenCounter(merges).counts(texts) == library(texts)


def test_every_kind_of_letter(library, merges):
    """Code points whose class differs between Unicode versions count as in the library."""
    codes = [c for c in [*range(0x250, 0x3000, 3), *range(0xA000, 0xD7FF, 37), *range(0x10000, 0x110000, 97)] if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} " for c in codes[i : i + 50]) for i in range(0, len(codes), 50)]
    assert token_counts.TokenCounter(merges).counts(texts) == library(texts)


def test_a_full_memory_starts_afresh(library, merges, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    counter = token_counts.TokenCounter(merges)
    texts = [f"some words {i} and others {i * i} of text" for i in range(200)]
    assert [n for i in range(0, 200, 10) for n in counter.counts(texts[i : i + 10])] == library(texts)


def test_pair_table():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    table = token_counts.PairTable(pairs, np.arange(len(pairs)))
    slots = table.find(pairs[:, 0], pairs[:, 1])
    assert (table.products[slots] == np.arange(len(pairs))).all() and (table.ranks[slots] == np.arange(len(pairs))).all()
    absent = table.find(pairs[:, 0] + 1000, pairs[:, 1])
    assert (table.ranks[absent] == np.iinfo(np.int32).max).all()


def test_messy_rows(messy, library):
    rows = token_counts.count_tokens(messy, PATH, limit=30).collect()
    texts = [t for _, t in texts_of()]
    want = Counter((d, len(t.encode()), n, n > 30) for (d, t), n in zip(texts_of(), library(texts)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert Counter(str(r["row"]) for r in rows) == Counter(map(str, messy.collect())) and len(rows) == len(MESSY)


def test_no_rows(nothing):
    assert token_counts.count_tokens(nothing, PATH).isEmpty()
