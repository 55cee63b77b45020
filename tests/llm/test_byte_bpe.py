"""Byte-level BPE against the library."""

import hashlib
import random

import pytest
import tiktoken

from tests.llm.cases import awkward, documents, empty
from tidemark.llm import bytebpe as B
from tidemark.llm.corpus_queries import tokenizer_file

RANKS = tokenizer_file("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return B.RankTokenizer(RANKS)


@pytest.fixture(scope="module")
def library(own):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def same(own, library, texts):
    for text, (ids, _) in zip(texts, own.encode([t.encode() for t in texts])):
        assert own.ids(ids).tolist() == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_random_texts(own, library):
    rng = random.Random(1)
    signs = [*"ab'strevlmd  \n\t 12!?\0\x1c'", " ", "　", "é", "漢", "’", "ſ", "́", "😀", " '", "'s", "'re", "'ll", "  ", "\r\n"]
    for _ in range(200):
        same(own, library, ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(30)])


def test_every_code_point(own, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(2).shuffle(points)
    same(own, library, ["".join(points[i:i + 5000]) for i in range(0, len(points), 5000)])


def test_long_runs_and_cuts(own, library, monkeypatch):
    monkeypatch.setattr(B, "STEP_BYTES", 3000)
    rng = random.Random(3)
    words = " ".join(rng.choice(["don't", "naïve", "x" * 70, "a", "", "...", "12 345", "it's  so"]) for _ in range(4000))
    same(own, library, ["", "x" * 9000, "ab" * 5000, "\n" * 4000, words, "", words[:2999], "a b " * 3000])
    assert len(B.cuts(words.encode(), 3000)) > 3


def test_heap_and_list_agree(own):
    rng = random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choices("abestnr'é", k=rng.randint(2, 60))).encode()
        if piece not in own.ranks:
            assert own.merge(piece) == own._merge_long(piece)


def test_small_memory_of_pieces(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_PIECES", 50)
    own = B.RankTokenizer(RANKS)
    rng = random.Random(5)
    for _ in range(20):
        same(own, library, [" ".join(str(rng.randrange(3000)) + rng.choice(["word", "Wort", "mot"]) for _ in range(100))])
    assert len(own.lately) <= 50 and len(own.before) <= 50


def test_spans_from_marks(own):
    text = "".join(f"Ein Satz, naïve {i}.\n" for i in range(3000)).encode()
    ids, marks = next(own.encode([text]))
    assert len(marks) >= 16 * 10
    rng = random.Random(6)
    for _ in range(200):
        a, n = rng.randrange(len(text) + 5), rng.randrange(400)
        assert own.decode_span(ids, marks, a, n) == text[a:a + n]


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_round_trip(spark, base, library, make):
    docs = make(spark, base) if make is documents else make(spark)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r[1] or "").encode()).hexdigest()))
    found = [tuple(r) for r in B.round_trip(docs, RANKS).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(found, key=str) == sorted(want, key=str)
    texts = B.decode_documents(B.encode_documents(docs, RANKS), RANKS).collect()
    assert sorted((r[0], bytes(r[1])) for r in texts if r[0] is not None) == sorted(
        (r[0], (r[1] or "").encode()) for r in docs.select("doc_id", "text").collect() if r[0] is not None)
