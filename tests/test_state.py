"""Saved state: the store, the neighbour index, serving, augmentation and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import conformal as CF
from tidemark.operators import knn as K
from tidemark.operators import knn_index as KI
from tidemark.operators import lifecycle as L
from tidemark.operators import models as MD
from tidemark.operators import serving
from tidemark.operators.bridge import FeatureBridge
from tidemark.operators.store import ConcurrentPublish, Store
from tidemark.plans import scoring_queries as SQ
from tidemark.plans import state_queries as ST
from tidemark.sources import customers as C
from tidemark.streaming import jobs


def test_versions_replays_crashes_and_rollback(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.current() is None and store.of_batch("a") is None
    first = store.publish(store.stage(), {"x": 1}, "a b/ü")
    assert store.current() == first and store.of_batch("a b/ü").meta == {"x": 1}
    second = store.publish(store.stage(), {"x": 2}, "c", first)
    with pytest.raises(ConcurrentPublish):
        store.publish(store.stage(), {"x": 3}, "late", first)
    # a writer that died while writing its manifest
    (tmp_path / "store" / "manifests" / "0000000003-dead.json").write_text('{"state": {"fol')
    assert store.current() == second and store.of_batch("dead") is None
    assert store.rollback(1).number == 4 and store.current().meta == {"x": 1}
    assert store.publish(store.stage(), {"x": 5}, "e", store.current()).number == 5


def clustered(spark, n=3000, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, dims)) * 3
    x = centre[rng.integers(0, 40, n)] + rng.normal(size=(n, dims))
    rows = [("a" if i % 3 else "b", i, v.tolist()) for i, v in enumerate(x)]
    rows += [("b", n, None), ("b", n + 1, [None] * dims), ("c", n + 2, x[0].tolist()), ("c", n + 3, x[0].tolist())]
    return spark.createDataFrame(rows, "grp string, id bigint, vec array<double>")


def test_index_finds_most_neighbours_and_compares_few(spark, tmp_path):
    df = clustered(spark)
    complete = df.where(KI.complete(F.col("vec")))
    refs, queries = df.withColumnRenamed("id", "rid"), df.withColumnRenamed("id", "qid")
    exact = K.knn_join(complete.withColumnRenamed("id", "qid"), complete.withColumnRenamed("id", "rid"), exclude_self=True)
    want = {tuple(r) for r in exact.select("grp", "qid", "rid", "dist", "rank").collect()}
    index = KI.build(refs)
    assert {tuple(r) for r in KI.search(index, queries, exclude_self=True).select("grp", "qid", "rid", "dist", "rank").collect()} == want
    tuned = KI.calibrate(index, queries, exclude_self=True, sample_queries=200)
    tuned.save(str(tmp_path / "index"))
    again = KI.Index.load(spark, str(tmp_path / "index"))
    found = {r.grp: r for r in KI.recall(again, queries, exact, exclude_self=True).collect()}
    for g in "ab":
        assert found[g].recall >= 0.9 and found[g].compared < 0.5 * found[g].queries * found[g].refs
    assert found["c"].recall == 1.0
    got = {tuple(r) for r in KI.search(again, queries, exclude_self=True, tile_rows=64).select("grp", "qid", "rid").collect()}
    assert len(got & {r[:3] for r in want}) >= 0.9 * len(want)


def test_index_routes_a_query_as_one_row(spark, monkeypatch):
    """Whatever the number of slabs; and blocks of any size find the same."""
    df = clustered(spark, n=1500)
    refs, queries = df.withColumnRenamed("id", "rid"), df.withColumnRenamed("id", "qid")
    index = KI.calibrate(KI.build(refs), queries, exclude_self=True, sample_queries=200)
    whole = {tuple(r) for r in KI.search(index, queries, exclude_self=True).collect()}
    monkeypatch.setattr(K, "TILE_ROWS", 16)
    monkeypatch.setattr(K, "BLOCK_TILES", 2)
    routed = KI.route(index, queries, 6)
    assert routed.count() == queries.where(KI.complete(F.col("vec"))).count()
    assert KI._slabs(index).agg(F.max("slab")).first()[0] > 10
    assert {tuple(r) for r in KI.search(index, queries, exclude_self=True, tile_rows=16).collect()} == whole


def test_index_of_nothing_and_of_copies(spark):
    df = spark.createDataFrame([("g", i, [1.0, 2.0]) for i in range(50)], "grp string, rid bigint, vec array<double>")
    queries = df.withColumnRenamed("rid", "qid").limit(3)
    got = KI.search(KI.build(df), queries).collect()
    assert len(got) == 15 and {r.rid for r in got} == set(range(5))
    none = KI.build(df.limit(0))
    assert KI.search(none, queries).count() == 0


def test_saved_state_scores_like_the_fitted_one(spark, base, tmp_path):
    upload = SQ.uploaded_batch(spark, base)
    fitted = {tuple(r) for r in SQ.decision_rows(spark, base).collect()}
    store = Store(spark, str(tmp_path / "store"))
    serving.publish_state(store, ST.ecommerce_state(spark, base), "first")
    state = serving.load_state(store, SQ.ecommerce_risk)
    assert {tuple(r) for r in SQ.decisions_of(serving.score_with(state, upload)[1]).collect()} == fitted


def test_repeated_and_null_ids_keep_their_rows(spark, base):
    upload = SQ.uploaded_batch(spark, base)
    one = {r["customer_id"]: r for r in serving.score_with(ST.ecommerce_state(spark, base), upload)[1].collect()}
    same = upload.withColumn("Customer_ID", F.when(F.col("Customer_ID") % 3 > 0, F.lit(7)).cast("bigint"))
    rows = serving.score_with(ST.ecommerce_state(spark, base), same)[1].collect()
    assert len(rows) == upload.count() and {r["customer_id"] for r in rows} == {7, None}
    key = lambda r: (round(r.p_final, 9), round(r.avg_similarity, 9), len(r.sources))
    assert sorted(map(key, rows)) == sorted(map(key, one.values()))


def test_proxy_scores_find_their_rows(spark):
    rows = [(None if i % 4 == 0 else i % 10, i % 50, float(i % 7), float(i % 11), "Yes" if i % 7 > 3 else "No") for i in range(400)]
    df = spark.createDataFrame(rows, "customer_id bigint, Tenure int, WarehouseDistance double, Gadgets double, Churn string")
    out = FeatureBridge("ecommerce", proxy=lambda *a: MD.train_proxy(*a, iterations=5)).transform(df).df
    assert out.count() == 400 and out.where("proxy_probability is null").count() == 0
    assert out.where("customer_id is null").count() == 100 and "__row" not in out.columns
    right = out.where("(proxy_probability >= 0.5) = (churned = 1)").count()
    assert right == 400


def uploads(spark, base):
    df = C.feature_table(spark, base).drop("industry")
    return df.where("split <> 'test'").drop("split"), df.where("split = 'test'").drop("split")


QUICK = {"folds": 2, "params": {"maxIter": 3, "numTrees": 3, "maxDepth": 2}, "tolerance": 0.25}  # few calibration rows


def test_augmentation_publishes_all_or_nothing(spark, base, tmp_path):
    old, new = uploads(spark, base)
    store = Store(spark, str(tmp_path / "store"))
    counts, first = L.augment_store(store, old, "spring.csv", "ecommerce", "customer_id", "march", SQ.EC_KNN, **QUICK)
    assert counts["train_records_added"] + counts["val_records_added"] == old.count()
    # rejected, and broken off in the middle: nothing is published
    with pytest.raises(CF.CalibrationQualityError):
        L.augment_store(store, new, "a.csv", "ecommerce", "customer_id", "bad", SQ.EC_KNN, **{**QUICK, "tolerance": -1.0})
    with pytest.raises(Exception):
        L.augment_store(store, new, "a.csv", "ecommerce", "customer_id", "broken", SQ.EC_KNN, folds=2, params={"maxIter": -1})
    assert store.current() == first and L.training_rows(store, first).count() == old.count()
    counts, second = L.augment_store(store, new, "x_TRAIN.csv", "ecommerce", "customer_id", "april", SQ.EC_KNN, **QUICK)
    assert counts == {"industry": "ecommerce", "train_records_added": new.count(), "val_records_added": 0}
    again = L.augment_store(store, old, "x_TRAIN.csv", "ecommerce", "customer_id", "april", SQ.EC_KNN, **QUICK)
    assert again == (counts, second) and store.current() == second
    state = serving.load_state(store)
    assert isinstance(state.scorer, MD.StackedModel) and state.payload.count() > old.count() * 0.7
    _, scored = serving.score_with(state, SQ.uploaded_batch(spark, base))
    assert scored.count() == SQ.uploaded_batch(spark, base).count()
    assert scored.where("p_final between 0 and 1 and size(sources) = 3").count() == scored.count()


def test_stream_decisions_and_quarantine(spark, base, tmp_path):
    folder, schema = ST.landed_csv(spark, base)
    store = Store(spark, str(tmp_path / "store"))
    serving.publish_state(store, ST.ecommerce_state(spark, base), "first")
    state = serving.load_state(store, SQ.ecommerce_risk)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        jobs.decide_arriving(jobs.arriving_csv(spark, folder, schema, 1), state, list(SQ.UPLOAD), f"{out}/rows", f"{out}/bad", f"{out}/cp")
    rows = SQ.shown(spark.read.parquet(f"{out}/rows").drop("batch_id"))
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in SQ.decision_rows(spark, base).collect()}
    assert sorted(r.line[:3] for r in spark.read.parquet(f"{out}/bad").collect()) == ["1,2", "xxx"]


def test_first_labels_survive_repeated_files(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.createDataFrame([(i, "ab"[i % 2], i % 3 % 2) for i in range(60)], "id bigint, g string, y int")
    more = spark.createDataFrame([(i, "ab"[i % 2], 1) for i in range(30, 90)], "id bigint, g string, y int")
    counts = None
    for df in (first, first, more, first):
        df.coalesce(1).write.mode("append").parquet(folder)
        counts = jobs.first_labels(jobs.arriving(spark, folder, first.schema), "id", ["g", "y"], out, f"{out}/cp")
    want = first.unionByName(more.where("id >= 60")).groupBy("g", "y").count()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
