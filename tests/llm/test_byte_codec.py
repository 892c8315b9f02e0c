"""Ids and bytes against the rank files' own library."""

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from conftest_llm import texts_of
from pyspark.sql import functions as F

from assaybook.llm import byte_codec, ragged

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_codec.read_ranks(PATH)


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_codec.ByteCodec(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def agree(codec, library, texts):
    ids, counts = codec.ids(texts)
    decoded = codec.decode_lists(ids, counts).to_pylist()
    start = 0
    for text, n, back in zip(texts, counts.tolist(), decoded):
        want = library.encode_ordinary(text)
        assert ids[start : start + n].tolist() == want, text
        assert back == library.decode_bytes(want) == text.encode()
        start += n


def test_every_entry_alone_and_beside_itself(codec, library, ranks):
    texts = [e.decode() for e in ranks if e.decode("utf-8", "replace").encode() == e]
    agree(codec, library, texts + [t + t for t in texts] + ["x" + t for t in texts])


def test_fuzz(codec, library):
    random.seed(3)
    letters = "   \n\t\x1c\x85　'sreabtionAÉß中𠀀é՘₏⁇<unk>|endoftext\U00011de0!…☃\x00\r0123"
    agree(codec, library, ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(6000)])


def test_runs(codec, library):
    agree(codec, library, [" " * k + "a" for k in range(40)] + ["a" * k for k in range(70)] + ["the" * 700, "\n" * 30, "", " ", "<|endoftext|>", "x" * 5000])


def test_characters_of_a_newer_unicode_are_cut_as_the_library_cuts(codec, library):
    assert codec.gaps
    odd = [body[0] for body in codec.gaps.values()]
    agree(codec, library, [f"a{c}b {c}{c} 1{c}" for c in odd])


def test_merges_follow_ranks_by_bytes_and_not_by_listed_pairs():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"aa": 259}
    own = byte_codec.ByteCodec(ranks, r"\S+|\s+")
    library = tiktoken.Encoding("toy", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    agree(own, library, ["abc", "abcabc", "aab", "aaa", "aaaaa", "xabc bcab"])


def test_gaps_in_the_ranks_and_bad_vocabularies(ranks):
    gappy = {e: r + (r > 300) * 7 for e, r in ranks.items() if r < 2000}
    own = byte_codec.ByteCodec(gappy, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("gappy", pat_str=public_tokenizers.PATTERN, mergeable_ranks=gappy, special_tokens={})
    agree(own, library, ["the other words of this text", "été"])
    for ids in ([305], [-1], [5000]):
        with pytest.raises(ValueError):
            own.decode(ids)
    with pytest.raises(ValueError):
        byte_codec.ByteCodec({b"a": 0}, ".")
    with pytest.raises(ValueError):
        byte_codec.ByteCodec({bytes([b]): 0 for b in range(256)}, ".")


def test_a_full_memory_starts_afresh(codec, library, monkeypatch):
    monkeypatch.setattr(ragged, "REMEMBERED", 20)
    for i in range(30):
        agree(codec, library, [f"some words {i} and others {i * i} of text"])


def test_messy_rows(spark, messy, codec, library):
    coded = byte_codec.encode_documents(messy, PATH, public_tokenizers.PATTERN)
    rows = coded.collect()
    want = Counter((d, tuple(library.encode_ordinary(t)), t.encode()) for d, t in texts_of())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in rows) == want
    assert Counter(str(r["row"]) for r in rows) == Counter(map(str, messy.collect()))
    again = coded.select("decoded", byte_codec.decoded(F.when(F.size("ids") > 0, F.col("ids")), codec).alias("again"))
    assert again.filter("decoded <> again").isEmpty()


def test_no_rows(nothing):
    assert byte_codec.encode_documents(nothing, PATH, public_tokenizers.PATTERN).isEmpty()
