"""The exact join where boxes tell nothing apart: blocks of rows, compared in single precision first."""

import numpy as np
import pytest
from tests.test_kd import brute

from tidemark.operators import knn as K
from tidemark.operators.kd import Tree, set_cells


def rows_of(spark, x, ids):
    df = spark.createDataFrame([("", i, v.tolist()) for i, v in zip(ids, x)], "grp string, id bigint, vec array<double>")
    return df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "rid")


def test_many_dimensions_are_joined_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(600, 64))
    x[100:130], x[7] = x[5], x[8] + 1e-7
    ids = np.arange(600) + 2 ** 60
    queries, refs = rows_of(spark, x, ids.tolist())
    written, write = {}, K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    got = K.knn_join(queries, refs, exclude_self=True, broadcast_values=1_000, tile_rows=8)
    want = {(int(ids[i]), int(ids[c]), d) for i, c, d in brute(ids, x, ids, x, 5, True)}
    assert {(r.qid, r.rid, r.dist) for r in got.collect()} == want and got.count() == 3_000
    # a query used to be written once for each of the cells
    assert "knn-queries" not in written or written["knn-queries"].count() <= 600


def test_blocks_take_null_and_repeated_ids_and_several_groups(spark):
    x = np.random.default_rng(5).normal(size=(240, 64))
    ids = [None if i % 5 == 0 else i // 2 for i in range(240)]
    rows = [("ab"[i % 2] if i % 7 else None, ids[i], x[i].tolist()) for i in range(240)] + [("c", 1, x[0].tolist())]
    df = spark.createDataFrame(rows, "grp string, id bigint, vec array<double>")
    queries, refs = df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "rid")
    key = lambda r: (r.grp, str(r.qid), str(r.rid), r.dist, r["rank"])
    got = sorted(map(key, K.knn_join(queries, refs, broadcast_values=1_000, tile_rows=4).collect()))
    kept = [(g, i, np.array(v)) for g, i, v in rows if g is not None]
    want = []
    for g in "abc":
        own = sorted(((i, v) for h, i, v in kept if h == g), key=lambda r: (r[0] is None, r[0] or 0))
        r = np.stack([v for _, v in own])
        by = {}
        for at, c, d in brute(range(len(own)), r, range(len(own)), r, 5, False):
            by.setdefault(own[at][0], []).append((d, own[c][0] is not None, own[c][0] or 0, c))
        for qid, hits in by.items():
            want += [(g, str(qid), str(own[c][0]), d, n + 1) for n, (d, _, _, c) in enumerate(sorted(hits)[:5])]
    assert [w[:2] + w[3:] for w in got] == [w[:2] + w[3:] for w in sorted(want)]
    assert got == sorted(want)


@pytest.mark.parametrize("middle, spread", [(0.0, 1.0), (1e5, 1e-3), (1e20, 1e18)])
def test_products_of_single_precision_lose_nothing(middle, spread):
    """Near pairs far from the middle of all rows are beyond single precision."""
    rng = np.random.default_rng(6)
    r = np.r_[rng.normal(size=(1_500, 48)), middle + spread * rng.normal(size=(1_500, 48))]
    r[40:60] = r[39]
    rid, at = np.arange(3_000), rng.integers(0, 3_000, 300)
    row, col, d = Tree(rid, r, 6, leaf=64).nearest(rid[at], r[at], 5, True)
    assert list(zip(row.tolist(), rid[col].tolist(), d.tolist())) == [(i, c, e) for i, c, e in brute(rid[at], r[at], rid, r, 5, True)]


def test_cells_that_are_set():
    mask = np.random.default_rng(7).random((9, 64)) < 0.05
    for part in (mask, mask[:, :13].copy(), mask[:0], np.zeros((3, 8), bool)):
        assert [x.tolist() for x in set_cells(part)] == [x.tolist() for x in np.nonzero(part)]
