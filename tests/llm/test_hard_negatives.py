"""Hard negatives against plain sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg as H

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, shard string, key string, positives string"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    clean = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((i, label, [math.floor(256 * x) if abs(x) < 2.0 ** 45 else int(256 * x) for x in v]))
    out = []
    for i, label, v in {(i, label, tuple(v)): (i, label, v) for i, label, v in clean if anchor(i)}.values():
        scored = [(-max(H.LEAST, min(H.MOST, sum(a * b for a, b in zip(v, w)))), j, other) for j, other, w in clean if len(w) == len(v)]
        best = sorted((s, j) for s, j, other in scored if other == label and j != i)[:positives]
        for p_rank, (p, j) in enumerate(best, 1):
            p = -p
            fit = sorted((s, k) for s, k, other in scored if other != label and low * p <= 100 * -s <= high * p)[:negatives]
            out += [(i, j, p_rank, r, k, p, -s) for r, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, anchor=lambda c: c % 10 == 0, schema=SCHEMA, **how):
    extra = len(schema.split(",")) - 3
    df = spark.createDataFrame([(*r, *["x"] * extra) for r in rows], schema)
    return sorted(tuple(r)[:7] for r in H.hard_negatives(df, anchor(F.col("vec_id")), **how).collect())


@pytest.mark.parametrize("how", [{}, {"shard_rows": 60, "bucket_rows": 16}, {"shard_rows": 3, "bucket_rows": 2}])
def test_random_vectors(spark, how):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 8))
    rows = [(i, (centre[i % 4] * rng.uniform(0.1, 3) + rng.normal(size=8) * 0.3).round(2).tolist(), int(i % 4 if i % 9 else 0)) for i in range(400)]
    assert run(spark, rows, **how) == brute(rows, lambda i: i % 10 == 0)


def test_ties_nulls_repeats_and_lengths(spark):
    one = [1.0, 0.0]
    rows = [(0, one, 1), (0, one, 1), (0, [0.5, 0.5], 2), (None, one, 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 1),
            (4, [float("inf"), 1.0], 1), (5, one, None), (6, one, 1), (7, one, 1), (8, [0.5, 0.1], 2), (9, [0.5, 0.2], 2), (10, [0.0, 0.0], 1),
            (11, [0.5, 0.3], 3), (20, [], 1), (21, [], 1), (22, [], 2), (30, [1.0, 0.0, 1.0], 1), (40, [-1.0, 0.0], 2)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows, bucket_rows=1) == brute(rows, lambda i: i % 10 == 0)


def test_huge_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(-3, 40)).tolist(), i % 3) for i in range(120)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_nothing_and_one_label(spark):
    assert run(spark, []) == []
    rows = [(i, [float(i), 1.0], 1) for i in range(30)]
    assert run(spark, rows) == []


def test_pruning_leaves_rows_out():
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(20, 16))
    which = rng.integers(0, 20, 4000)
    v = np.floor(256 * (centre[which] + rng.normal(size=(4000, 16)) * 0.1))
    own = H.buckets_of(np.arange(4000), which.astype(np.int64), v, 200)
    read = 0
    for a in range(0, 4000, 100):
        best = H.Best(5)
        seen, total = H.search(own, a, int(which[a]), v[a], True, [best])
        want = sorted((-s, i) for i, s in enumerate((v @ v[a]).tolist()) if which[i] == which[a] and i != a)[:5]
        assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want
        read += seen / total
    assert read / 40 < 0.5
