"""Groups, links and counts against a plain walk over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import MESSY, texts_of
from tokenizers import Tokenizer

from assaybook.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def byte_of_letter():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def brute(rows):
    """The contract, word for word, over (doc_id, text) rows."""
    tok, spm, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_letter()
    tok.encode_special_tokens = True
    piece = lambda i: bytes([int(spm.id_to_piece(i)[3:5], 16)]) if spm.is_byte(i) else spm.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = spm.encode(text) if text else []
        bytes_a, bytes_b = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or not (" " + text).encode() == b"".join(bytes_a) == b"".join(bytes_b):
            docs.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([i for i, e in zip(a, ends_a) if s < e <= c], [i for i, e in zip(b, ends_b) if s < e <= c]) for s, c in zip([0] + cuts, cuts)]
        at_a, at_b = {}, {}
        for ids, ends, at in ((a, ends_a, at_a), (b, ends_b, at_b)):
            for i, e in zip(ids, ends):
                at.setdefault(e, []).append(i)
        links = [(x, y) for e in cuts for x in at_a[e] for y in at_b[e]]
        counts.update(links)
        docs.append((doc, a, b, groups, links))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return Counter(
        (doc, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
         ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
        for doc, a, b, groups, links in docs
    )


def got(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_messy_rows(messy):
    out = alignment.align_tokenizers(messy, A, B)
    assert got(out) == brute(texts_of())
    assert out.filter("size(a) <> n_a or size(b) <> n_b or size(a_sizes) <> n_groups or size(b_sizes) <> n_groups").isEmpty()
    assert out.count() == len(MESSY)


def test_odd_texts(make):
    random.seed(6)
    letters = "   \n\t▁ethisonar,.!$AÉß中𠀀é　\xa0\r0123՘"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(400)]
    texts += ["<|endoftext|> <s></s><unk>", "▁", " ", "\n", "a" * 3000, "the other " * 900, "\x00\x01", "é" * 700, "中文" * 800]
    rows = [(k, t) for k, t in enumerate(texts)]
    assert got(alignment.align_tokenizers(make(rows), A, B)) == brute(rows)


def test_ends_meet_whatever_the_stretch():
    rng = np.random.default_rng(7)
    for stretch in (1, 3, 17, 1000):
        sizes = rng.integers(0, 60, 30)
        ends = np.cumsum(sizes)
        docs = set(ends[sizes > 0].tolist())
        a = np.array(sorted(set(rng.integers(1, ends[-1], 400).tolist()) | docs))
        b = np.array(sorted(set(rng.integers(1, ends[-1], 500).tolist()) | docs))
        cut_a, cut_b = alignment.shared_ends(a, b, ends, stretch)
        common = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[cut_a].tolist() == common == b[cut_b].tolist()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.shared_ends(none, none, np.zeros(3, np.int64))] == [0, 0]


def test_linked_pairs_have_a_bound():
    table = alignment.TokenBytes
    a, b = table([b"a", b"ba", b"cba", b"", b"x"]), table([b"a", b"ba", b"a", b"xcba", b"ax"])
    # a-a twice, a-ba, ba-a twice, ba-ba, cba-a twice, cba-ba, a-xcba, ba-xcba, cba-xcba, x-ax
    assert alignment.most_pairs(a, b) == 13


def test_hashes_of_groups_in_the_query(spark, tmp_path, make):
    from assaybook.llm import queries

    rows = [(1, "alpha beta"), (2, ""), (None, None), (3, "alpha beta gamma")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute([(d, t or "") for d, t in rows]))
    assert Counter(map(tuple, queries.QUERIES["op11_token_alignment"](spark, str(tmp_path)).collect())) == want


def test_no_rows(nothing):
    out = alignment.align_tokenizers(nothing, A, B)
    assert out.isEmpty() and set(COLUMNS) <= set(out.columns)


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    import json

    with pytest.raises(ValueError):
        alignment.byte_level_codec(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(A))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        alignment.byte_level_codec(str(tmp_path / "other.json"))


def test_words_join_to_the_text_and_a_full_memory_starts_afresh(monkeypatch):
    random.seed(9)
    for _ in range(3000):
        text = "".join(random.choice("ab  \n\t\x1c\u00a0\u2003.") for _ in range(random.randint(1, 12)))
        assert "".join(" " + w for w in alignment.words(text)) == " " + text
    monkeypatch.setattr(alignment, "REMEMBERED", 15)
    aligner = alignment.Aligner(alignment.byte_level_codec(A), alignment.PieceTokens(B))
    tok, spm = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    for i in range(20):
        text = f"some words {i} and  others {i * i}\n of text"
        (a, _), (b, _) = aligner.encode([text])
        assert a.tolist() == tok.encode(" " + text).ids and b.tolist() == spm.encode(text)
