"""Phrase collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import LONG, awkward, documents, empty, lower
from tidemark.llm import collocations as C


def brute(rows, min_count, longest, top, absorb=100):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            sizes[lang] += len(words)
            own.update(tuple(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        cover = Counter()
        for p, a in good.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    cover[p[i:i + n]] = max(cover[p[i:i + n]], a)
        found = []
        for p, a in good.items():
            if cover[p] * 100 >= absorb * a:
                continue
            cut = min((1000 * a * sizes[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-cut[0], -a, " ".join(p).encode(), own[p[:cut[1]]], own[p[cut[1]:]], cut[1]))
        for rank, (score, a, phrase, left, right, k) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score, k))
    return sorted(out)


def rows_of(docs):
    return [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]


@pytest.mark.parametrize("limits", [{}, {"trie_entries": 300, "burst": 3, "merge_entries": 50}])
def test_documents(spark, base, limits):
    docs = documents(spark, base)
    found = C.collocations(docs, min_count=4, top=300, **limits).collect()
    assert sorted(map(tuple, found)) == brute(rows_of(docs), 4, 5, 300)
    assert len(found) > 400


def test_a_weaker_cover(spark, base):
    docs = documents(spark, base)
    found = C.collocations(docs, min_count=10, longest=3, top=10_000, absorb=60).collect()
    assert sorted(map(tuple, found)) == brute(rows_of(docs), 10, 3, 10_000, 60)


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_rows(spark, make):
    docs = make(spark)
    found = C.collocations(docs, min_count=2, top=50).collect()
    assert sorted(map(tuple, found)) == brute(rows_of(docs), 2, 5, 50)


def test_null_language_ties_and_repeats(spark):
    rows = [(None, "x y z, x y z"), ("und", "x y. a b; a b"), ("de", "é ü ab\x1ccd Ä Ä"), ("de", "é ü ab\x1ccd ä Ä"),
            ("en", "go go go go"), ("", "p q\tp  q"), ("en", None)] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = C.collocations(docs, min_count=2, top=6).collect()
    assert sorted(map(tuple, found)) == brute(rows, 2, 5, 6)


def test_a_trie_keeps_counts_while_it_bursts_and_spills():
    rng = np.random.default_rng(4)
    trie, want, out = C.HatTrie(4), Counter(), Counter()
    for step in range(60):
        n = int(rng.integers(3, 6))
        words = np.unique(rng.integers(1, 5, (40, n)).astype(np.uint64), axis=0)
        counts = rng.integers(1, 9, len(words))
        trie.insert(words, counts)
        for w, c in zip(words.astype(">u8"), counts.tolist()):
            want[w.tobytes()] += c
        if step % 7 == 6:
            for head in trie.largest(trie.size // 3):
                out.update(dict(trie.subtree(head)))
    for head in trie.largest(trie.size):
        for key, c in trie.subtree(head):
            out[key] += c
    assert out == want and trie.size == 0 and not trie.root


def test_words_of_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "TEXT_STEP", 50)
    text = (LONG[:5000] + ". ").encode() * 3
    pieces = lambda words: [p.split(b" ") for p in b" ".join(words).split(C.BREAK) if p.strip()]
    got = pieces([w for step in C.words_in(text) for w in step])
    monkeypatch.setattr(C, "TEXT_STEP", 1 << 30)
    assert got == pieces([w for step in C.words_in(text) for w in step])


def test_filter_has_all_it_was_given(spark):
    rows = [("en" if i % 2 else "de", i * 7919) for i in range(5000)]
    known = C.filter_of(C.word_keys(spark.createDataFrame(rows, "lang string, id long").repartition(3)))
    for lang in ("en", "de"):
        ids = np.array([i for x, i in rows if x == lang], np.uint64)[:, None]
        assert known.has(C.mixed(ids, lang)).all()
        assert known.has(C.mixed(ids + np.uint64(1), lang)).mean() < 0.1


def test_words_with_one_id_get_another_seed(spark, monkeypatch):
    real = C.word_id
    monkeypatch.setattr(C, "word_id", lambda word, seed: 5 if seed == 0 and word in (b"a", b"b") else real(word, seed))
    rows = [("en", "a b c a b c"), ("en", "b a. a b")] * 3
    found = C.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=3, top=9).collect()
    assert sorted(map(tuple, found)) == brute(rows, 3, 5, 9)
