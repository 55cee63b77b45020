"""The pipeline's near-duplicate stage: edited copies by the Jaccard similarity of five-word shingles."""

import random

import pytest

from tests.llm.cases import awkward, documents, empty
from tests.llm.test_copies import united
from tidemark.llm import minhash
from tidemark.llm.corpus_queries import drop_near_duplicates


def shingle_set(text):
    own = text.lower().split()
    return {tuple(own[k:k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / max(1, len(a | b))


def edited(rng, words, low, high):
    """A copy of the words whose similarity to them lies between low and high."""
    while True:
        out = list(words)
        for k in rng.sample(range(len(out)), rng.randrange(1, max(2, len(out) // 20))):
            out[k] = f"edit{rng.randrange(10**6)}"
        if low <= jaccard(" ".join(words), " ".join(out)) < high:
            return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_edited_copies_go(spark, base):
    rng = random.Random(3)
    rows, apart = [], []
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        low = (0.8, 0.85, 0.9)[k % 3]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(edited(rng, words, low, low + 0.05)))]
        if k < 30:
            apart.append(10 * k + 2)
            rows.append((10 * k + 2, " ".join(edited(rng, words, 0.5, 0.75))))
    got = {r["doc_id"] for r in drop_near_duplicates(spark, frame(spark, rows), base).collect()}
    assert {10 * k for k in range(150)} <= got and set(apart) <= got
    assert not {10 * k + 1 for k in range(150)} & got


@pytest.mark.parametrize("cell", (32, 4))
def test_a_crowd_of_edited_copies(spark, base, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(words)), *[(k, " ".join(edited(rng, words, 0.88, 0.99))) for k in range(1, 200)]]
    assert [r["doc_id"] for r in drop_near_duplicates(spark, frame(spark, rows), base).collect()] == [0]


def test_against_all_pairs(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(rows[i][0], rows[j][0]) for i, a in enumerate(sets) for j in range(i)
             if min(len(a), len(sets[j])) >= 0.8 * max(len(a), len(sets[j]))
             and len(a & sets[j]) >= 0.8 * len(a | sets[j])]
    roots = united([i for i, _ in rows], pairs)
    assert {r["doc_id"] for r in minhash.one_of_each_similar(docs).collect()} == set(roots.values())


def test_awkward_rows(spark, base):
    odd = awkward(spark)
    out = drop_near_duplicates(spark, odd, base)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["1", "3", "6", "7", "9", "9", "None", "10", "11", "12"])
    assert drop_near_duplicates(spark, empty(spark), base).count() == 0


def test_rows_without_id(spark, base):
    rows = [(None, "one text with a name elsewhere"), (4, "one text with a name elsewhere"),
            (None, "no name at all here"), (None, "no name at all here"), (None, "NO name at all here")]
    got = [(r["doc_id"], r["text"].lower()) for r in drop_near_duplicates(spark, frame(spark, rows), base).collect()]
    assert sorted(got, key=str) == [(4, "one text with a name elsewhere"), (None, "no name at all here")]


@pytest.mark.parametrize("shared", (0.60, 0.70, 0.76))
def test_near_copies_among_texts_that_share_a_template(spark, shared):
    """600 texts of one template crowd every cell; the planted near copies among them are found nevertheless."""
    rng = random.Random(9)
    size = 220
    own = round(size * (1 - shared) / (1 + shared))  # own words at the end, so that two texts are ``shared`` similar
    template = [f"t{k}" for k in range(size - own)]
    rows, planted = [], []
    for k in range(600):
        mine = [f"o{rng.randrange(10**9)}" for _ in range(own)]
        rows.append((10 * k, " ".join(template + mine)))
        if k % 4 == 0:
            near = list(mine)
            while jaccard(rows[-1][1], " ".join(template + near)) >= 0.86:
                near[-1 - mine[::-1].index(next(w for w in mine[::-1] if w in near))] = f"e{rng.randrange(10**9)}"
            text = " ".join(template + near)
            if jaccard(rows[-1][1], text) >= 0.8:
                planted.append((10 * k, 10 * k + 1))
                rows.append((10 * k + 1, text))
    docs = frame(spark, rows)
    own = minhash.materialize(minhash.sketches(docs, 5, "doc_id", "text"), "sketches")
    node = {r["doc_id"]: r["node"] for r in own.collect()}
    found = {(r["a"], r["b"]) for r in minhash.links(docs, own, 5, 0.8, "text").collect()}
    hits = sum((min(node[a], node[b]), max(node[a], node[b])) in found for a, b in planted)
    assert len(planted) > 100 and hits >= 0.99 * len(planted)


@pytest.mark.parametrize("tile", (1024, 64))
def test_near_copies_whose_shingles_are_all_common(spark, monkeypatch, tile):
    """Texts of one template that differ in the variants of twelve passages: no shingle is rare, and the groups are those of all pairs."""
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "CELL", 8)
    rng = random.Random(12)
    codes = sorted({tuple(rng.randrange(3) for _ in range(12)) for _ in range(400)})
    for c in codes[::4]:  # another variant of two passages
        at = rng.sample(range(12), 2)
        codes.append(tuple((v + (k in at)) % 3 for k, v in enumerate(c)))
    rng.shuffle(codes)
    template = [f"t{k}" for k in range(160)]
    rows = [(i, " ".join(template + [f"v{k}x{v}w{w}" for k, v in enumerate(c) for w in range(8)])) for i, c in enumerate(codes)]
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if len(a & sets[j]) >= 0.8 * len(a | sets[j])]
    roots = united(range(len(rows)), pairs)
    assert 90 < len(rows) - len(set(roots.values())) < 300
    assert min(sum(s in x for x in sets) for s in sets[0]) > 32
    assert {r["doc_id"] for r in minhash.one_of_each_similar(frame(spark, rows)).collect()} == set(roots.values())
