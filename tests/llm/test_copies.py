"""Near-duplicates, components and top-k search against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import WORDS, awkward, documents, empty, lower
from tidemark.llm import simhash, topk
from tidemark.llm.graph import components


def fingerprint(text):
    w = WORDS.findall(lower(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * counts[b] > len(shingles))


def united(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near(fps):
    own = sorted(set(fps))
    return [(a, b) for i, a in enumerate(own) for b in own[i + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]


def check(docs):
    rows = [(r[0], fingerprint(r[1])) for r in docs.select("doc_id", "text").collect()]
    of = united({f for _, f in rows}, near([f for _, f in rows]))
    heads = {}
    for i, f in rows:
        if i is not None:
            heads[of[f]] = min(i, heads.get(of[f], i))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id").collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(((i, f"{f:016x}", heads.get(of[f])) for i, f in rows), key=key)


def test_near_duplicates(spark, base):
    check(documents(spark, base))
    check(awkward(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark, base):
    docs = documents(spark, base)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs)
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in found.select("component_id").distinct().collect()}
    odd = awkward(spark)
    rows = simhash.one_of_each(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "3", "6", "7", "9", "9", "None", "None", "10", "11", "12"])


def test_links_of_crowded_cells(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(700):  # a hot group of fingerprints a few bits around one
        x = centre
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1, 1 << 63}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = united(signed, near(signed))
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for cell in (256, 3):  # the second goes the way of the largest cells
        monkeypatch.setattr(simhash, "CELL", cell)
        got = united(signed, [tuple(r) for r in simhash.links(df).collect()])
        assert got == want


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame([*pairs, (None, 5)], "a long, b long"), "a", "b").collect()}
    assert got == {k: v for k, v in united({x for p in pairs for x in p}, pairs).items() if any(k in p for p in pairs if p[0] != p[1])}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute(rows, k):
    out = []
    for q, v in rows:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), r) for r, w in rows if r != q and len(w) == len(v))
            out += [(q, i + 1, r, -x) for i, (x, r) in enumerate(s[:k])]
    return sorted(out)


def test_top_k(spark, base):
    vectors = spark.read.parquet(f"{base}/embeddings.parquet")
    rows = [(r[0], [int(np.floor(256 * float(x))) for x in r[1]]) for r in vectors.select("vec_id", "embedding").collect()]
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_top_k_of_awkward_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [3.0]), (50, [-1.0, 0.5]), (100, [2.0]), (150, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, [2e6, -3e6])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    plain = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    monkeypatch.setattr(topk, "SHARD_ROWS", 2)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 1)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == brute(plain, 3)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_and_mixed_components(spark):
    """Scores beyond 64 bits are the nearest 64-bit number; the others stay exact."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=3) * 10.0 ** int(rng.choice([-2, 0, 5, 9, 14, 30, 300]))).tolist()) for i in range(90)]
    whole = {i: [int(np.floor(x * 256.0)) for x in v] for i, v in rows}
    want = []
    for q in range(0, 90, 10):
        score = {i: max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(whole[q], whole[i])))) for i in whole if i != q}
        want += [(q, r, i, score[i]) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect())) == sorted(want)
