"""The groups of the hashed neighbour join stay bounded whatever the size of the input."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import knn as K


def test_packs_follow_the_rows(spark):
    rng = random.Random(2)
    rows = [("g", i, [rng.random(), rng.random()]) for i in range(600)]
    q = spark.createDataFrame(rows, "grp string, qid long, vec array<double>")
    r = q.withColumnRenamed("qid", "rid")
    how = {"width": 100.0, "tables": 2, "projections": 1, "tile_rows": 8}  # one bucket a table, many tiles
    sides = K._lsh_sides(q, r, **how)
    both = K._packed(*sides, how["tile_rows"])
    rows = both[0].select("pack").union(both[1].select("pack")).groupBy("pack").count().agg(F.max("count")).first()[0]
    assert rows <= 40 * how["tile_rows"]
    q, r = q.where("qid < 60"), r.where("rid < 60")
    found = K.knn_join_lsh(q, r, k=2, **how).select("qid", "rid", "rank").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, K.knn_join(q, r, k=2).select("qid", "rid", "rank").collect()))


def test_calibrated_buckets_narrow_as_neighbours_come_nearer(spark):
    shares = []
    for spacing in (1.0, 0.1):
        rng = np.random.default_rng(3)
        near = rng.uniform(-6, 6, size=(150, 1, 3)) + spacing * rng.uniform(-0.5, 0.5, size=(150, 8, 3))
        rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(near.reshape(-1, 3))], "grp string, id bigint, vec array<double>")
        out = K.lsh_recall(rows.withColumnRenamed("id", "qid"), rows.withColumnRenamed("id", "rid"), k=3, exclude_self=True).first()
        assert out.recall >= 0.9
        shares.append(out.compared / out.all_pairs)
    assert shares[1] < 0.5 and shares[1] < shares[0]


def test_copies_of_a_vector_are_compared_no_oftener_than_they_can_be_neighbours(spark):
    rows = [("a", i, [0.0, 0.0]) for i in range(400)] + [("a", 1000 + i, [9.0, float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "grp string, id bigint, vec array<double>")
    out = K.lsh_recall(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "rid"), k=2, width=1.0).first()
    assert out.recall >= 0.95 and out.compared < 400 * 400
