"""Token files, tokenizer pieces and language-model scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import WORDS, awkward, documents, empty, lower
from tidemark.llm import lmscore, rans, tokens
from tidemark.llm.corpus_queries import tokenizer_file

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PIECES = st.sampled_from(["a", "B", " ", "\n", "  ", "'s", "é", "É", "\t", " ", " 1", "23", "!", ".", "<|endoftext|>", "",
                          "\x1c", "İ", "ß", "中文", "́", " x", "don't", "\0", "word.", " tion,", "ﬁ", "\r\n"])


@pytest.mark.parametrize("name", FILES)
@given(texts=st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(name, texts):
    coder = tokens.load(tokenizer_file(name))
    ids, counts = coder.encode([t.encode() for t in texts])
    at = np.cumsum(counts) - counts
    for t, a, n in zip(texts, at, counts):
        assert ids[a:a + n].tolist() == coder.library.encode(t, add_special_tokens=False).ids


def test_pieces_after_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    monkeypatch.setattr(tokens, "STEP_BYTES", 20)
    coder = tokens.PieceTokenizer(tokenizer_file(FILES[0]))
    texts = [f"some words {i} and more of them {i * i}" for i in range(50)]
    ids, counts = coder.encode([t.encode() for t in texts])
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 300_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(1.0, n) * 20).astype(np.int64).clip(0, 49_000).astype(np.uint32)
    table = rans.scaled_frequencies(dict(Counter(ids.tolist())) or {0: 1})
    assert int(table.sum()) == 1 << rans.BITS
    lengths, docs = (np.array([n // 2, n - n // 2]), [None, -5])
    block = rans.Coder(table).encode(ids, lengths, docs)
    got, sizes, names = rans.Coder(table).decode(block)
    assert np.array_equal(got, ids) and sizes.tolist() == lengths.tolist() and names == docs
    if n == 300_000:
        p = np.bincount(ids)[ids] / n
        assert len(block) < 1.1 * -np.log2(p).sum() / 8 + 200_000  # words near the entropy; checkpoints besides
        lanes, steps, count, _, _, marks, words = rans.Coder.parts(block)
        part = np.zeros(count, np.uint32)  # from a checkpoint in the middle
        lo = rans.CHECKPOINT_STEPS
        rans.Coder(table).decode_from(marks[1], words, lanes, lo, min(steps, 2 * lo), count, part)
        assert np.array_equal(part[lo * lanes:2 * lo * lanes], ids[lo * lanes:2 * lo * lanes])
    with pytest.raises(ValueError):
        rans.Coder(table).decode(block[:-1] + bytes([block[-1] ^ 1]))


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_token_files(spark, base, make, monkeypatch):
    docs = make(spark, base) if make is documents else make(spark)
    path, table = rans.encode_corpus(docs, tokenizer_file(FILES[1]))
    got = rans.digest(spark, path, table).orderBy("start").collect()
    library = Tokenizer.from_file(tokenizer_file(FILES[1]))
    want = {(r["doc_id"], r["text"]): library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    crcs = Counter((r["doc_id"], len(want[r["doc_id"], r["text"]]), zlib.crc32(np.array(want[r["doc_id"], r["text"]], "<u4").tobytes()))
                   for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == crcs
    at, last = 0, -1
    for r in got:
        assert r["start"] == at and (r["doc_id"] is None or r["doc_id"] >= last)
        at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else last
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rans.read_blocks(spark, path, table).collect()}
    assert all(back[d] in [v for (e, _), v in want.items() if e == d] for d in back)


def brute(rows, order, mu):
    words = [(i, [*WORDS.findall(lower(t)), "\n"]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(tuple(w[a:a + k]) for (_, w), h in zip(words, held) if not h for k in range(1, order + 1) for a in range(len(w) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)
    out = []
    for (i, w), h in zip(words, held):
        base = score = 0.0
        for a in range(len(w)):
            p = (counts[(w[a],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, min(order - 1, a) + 1):
                p = (counts[tuple(w[a - k:a + 1])] + mu * p) / (counts[tuple(w[a - k:a])] + mu)
            score += math.log10(p)
        out.append((i, h, len(w), sum(counts[(x,)] > 0 for x in w), n, base, score))
    return out, counts, n, v


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_scores(spark, base, make, order, monkeypatch):
    monkeypatch.setattr(lmscore, "PART_BYTES", 60_000)
    docs = make(spark, base) if make is documents else make(spark)
    got = lmscore.score_documents(docs, order).collect()
    want, *_ = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], order, lmscore.MU)
    key = lambda r: (str(r[0]), r[2], round(r[6], 4))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one_and_help(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    held = [r for r in lmscore.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    rows = [(1, "a b a b c"), (2, "b a c")]
    _, counts, n, v = brute(rows, 2, lmscore.MU)
    for context in ("a", "b", "c", "new"):
        total = 0.0
        for w in ["a", "b", "c", "\n", "unknown"]:
            p = (counts[(w,)] + 1) / (n + v + 1)
            total += (counts[(context, w)] + lmscore.MU * p) / (counts[(context,)] + lmscore.MU)
        assert total == pytest.approx(1.0)


@pytest.mark.parametrize("name", FILES)
def test_pieces_whatever_was_met_before(name):
    """Words of a small alphabet, combining marks among it, in random order: a warm memory gives what a cold one does."""
    import random

    rng = random.Random(7)
    words = ["".join(rng.choices(["a", "İ", "ß", "é", "̇", "Σ", "ﬁ", ".", ",", "!", "'", "s", "1", "ǅ"], k=rng.randint(1, 5))) for _ in range(3000)]
    coder = tokens.PieceTokenizer(tokenizer_file(name))
    for _ in range(3):
        rng.shuffle(words)
        texts = [" ".join(words[i:i + 10]) for i in range(0, len(words), 10)]
        ids, counts = coder.encode([t.encode() for t in texts])
        at = 0
        for t, n in zip(texts, counts.tolist()):
            assert ids[at:at + n].tolist() == coder.library.encode(t, add_special_tokens=False).ids
            at += n
