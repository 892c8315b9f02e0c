"""Ids and texts against the sentencepiece library itself."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import MESSY, texts_of

from assaybook.llm import piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return piece_codec.PieceVocabulary(PATH)


def agree(vocabulary, library, texts):
    got = piece_codec.PieceCodec(vocabulary).round_trip(texts)
    for text, (ids, n, decoded) in zip(texts, got):
        want = library.encode(text)
        assert (ids, n, decoded) == (",".join(map(str, want)), len(want), library.decode(want)), text
        assert vocabulary.decode(want) == decoded


def test_fuzz(vocabulary, library):
    random.seed(3)
    letters = "   \n\t▁ethisonar,.!$AÉß中𠀀é　\xa0\r0123"
    agree(vocabulary, library, ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(4000)])
    agree(vocabulary, library, ["".join(random.choice(" ▁  ab\n") for _ in range(random.randint(0, 60))) for _ in range(1500)])


def test_pieces_side_by_side(vocabulary, library):
    random.seed(4)
    agree(vocabulary, library, ["".join(random.choice(vocabulary.pieces[259:]) for _ in range(random.randint(0, 9))) for _ in range(3000)])


def test_runs(vocabulary, library):
    agree(vocabulary, library, [" " * k + "a" for k in range(40)] + ["a" * k for k in range(40)] + ["the" * 700, "\n" * 30, "", " ", "<s></s><unk>"])


def test_pairs_stay_apart_as_the_library_says(vocabulary, library):
    rng = np.random.default_rng(5)
    left, right = rng.integers(259, 32000, 3000), rng.integers(259, 32000, 3000)
    plain = [not (vocabulary.pieces[a] + vocabulary.pieces[b]).startswith("▁") and "▁" not in vocabulary.pieces[b] for a, b in zip(left, right)]
    left, right = left[plain], right[plain]
    fits = vocabulary.compatible(left.astype(np.int32), right.astype(np.int32))
    for a, b, fit in zip(left.tolist(), right.tolist(), fits.tolist()):
        # behind a line feed a text has no space mark in front
        alone = library.encode("\n" + vocabulary.pieces[a] + vocabulary.pieces[b])[2:]
        assert fit == (alone == [a, b])


def test_a_full_memory_starts_afresh(vocabulary, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 20)
    codec = piece_codec.PieceCodec(vocabulary)
    for i in range(30):
        text = f"some words {i} and others {i * i} of text"
        assert codec.round_trip([text])[0][0] == ",".join(map(str, library.encode(text)))


def test_messy_rows(messy, library):
    rows = piece_codec.encode_documents(messy, PATH).collect()
    want = Counter((d, ",".join(map(str, library.encode(t))), len(library.encode(t)), library.decode(library.encode(t))) for d, t in texts_of())
    assert Counter((r["doc_id"], r["ids"], r["n_tokens"], r["decoded"]) for r in rows) == want
    assert Counter(str(r["row"]) for r in rows) == Counter(map(str, messy.collect()))
    stage = piece_codec.encode_stage(messy, PATH).collect()
    assert Counter((r["doc_id"], ",".join(map(str, r["ids"]))) for r in stage) == Counter((d, i) for d, i, _, _ in want.elements())
    assert len(stage) == len(MESSY)


def test_no_rows(nothing):
    assert piece_codec.encode_documents(nothing, PATH).isEmpty() and piece_codec.encode_stage(nothing, PATH).isEmpty()
