"""The k-d tree of the exact join: the neighbours of brute force at a share of its pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import knn as K
from tidemark.operators import knn_index as KI
from tidemark.operators.kd import Tree, distances


def brute(qid, q, rid, r, k, exclude_self):
    out = []
    for i, row in enumerate(np.floor(distances(q, r) * 1e6 + 0.5) / 1e6):
        found = sorted((d, c) for c, d in enumerate(row.tolist()) if np.isfinite(d) and not (exclude_self and qid[i] == rid[c]))
        out += [(i, c, d) for d, c in found[:k]]
    return out


@pytest.mark.parametrize("dims", [2, 7, 64])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_tree_equals_brute_force(dims, exclude_self):
    rng = np.random.default_rng(dims)
    r = np.round(rng.normal(size=(1500, dims)), 1)
    r[::3], r[5], r[6, 0], r[7, 0] = r[0], r[4] + 3e-7, np.nan, np.inf
    rid = np.sort(rng.integers(0, 1400, 1500))  # ids repeat
    at = rng.integers(0, 1500, 200)
    qid, q = rid[at], r[at] + np.where(np.arange(200) % 2, 0.0, 1e3)[:, None]
    row, col, d = Tree(rid, r, 5 + exclude_self, leaf=32).nearest(qid, q, 5, exclude_self)
    got, want = list(zip(row.tolist(), rid[col].tolist(), d.tolist())), [(i, int(rid[c]), d) for i, c, d in brute(qid, q, rid, r, 5, exclude_self)]
    assert got == want


def test_few_leaves_are_visited():
    x = np.random.default_rng(1).normal(size=(40_000, 3))
    tree = Tree(np.arange(len(x)), x, 5)
    seen, visits = [], tree.visits
    tree.visits = lambda q, limit: seen.append((visits(q, limit), len(q))) or seen[-1][0]
    tree.nearest(np.arange(4_000), x[:4_000], 5, True)
    pairs, asked = len(seen[-1][0][0]), seen[-1][1]
    assert pairs < 0.1 * asked * (1 << tree.levels)


def test_one_vector_of_many_rows_is_kept_to_its_first_ids(spark):
    refs = spark.range(5_000).select(F.lit("g").alias("grp"), F.col("id").alias("rid"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    assert sorted(r.rid for r in K.first_copies(refs, 5, False).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.rid for r in K.first_copies(refs, 5, True).collect()) == [0, 1, 2, 3, 4, 5]


def test_exact_index_routes_a_query_to_few_lists(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(rng.normal(size=(4_000, 2)))], "grp string, id bigint, vec array<double>")
    refs, queries = df.withColumnRenamed("id", "rid"), df.withColumnRenamed("id", "qid")
    sent, join = [], K.cell_join

    def watched(asked, placed, route, *how):
        def routed(bounds):
            sent.append(route(bounds).count())
            return route(bounds)
        return join(asked, placed, routed, *how)

    monkeypatch.setattr(K, "cell_join", watched)
    got = {tuple(r) for r in KI.search(KI.build(refs), queries).select("qid", "rid", "dist", "rank").collect()}
    assert got == {tuple(r) for r in K.knn_join(queries, refs).select("qid", "rid", "dist", "rank").collect()}
    assert sent[0] < 0.25 * 4_000 * 64  # 64 lists


def test_queries_of_one_partition_are_searched_in_several(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    rows = spark.createDataFrame([("", i, v.tolist()) for i, v in enumerate(x)], "grp string, id bigint, vec array<double>").coalesce(1)
    found = K.knn_join(rows.withColumnRenamed("id", "qid"), rows.withColumnRenamed("id", "rid"), k=1)
    per_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 300
    assert all(r.qid == r.rid and r.dist == 0 for r in found.collect())
