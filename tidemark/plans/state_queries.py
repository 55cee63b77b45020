"""Queries of saved state: the neighbour index, serving, augmentation and streams that go by a published version."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import conformal as CF
from tidemark.operators import knn as K
from tidemark.operators import knn_index as KI
from tidemark.operators import lifecycle as L
from tidemark.operators import serving
from tidemark.operators.store import Store
from tidemark.plans import scoring_queries as SQ
from tidemark.plans.learning_queries import SCALED, scaled_customers
from tidemark.plans.registry import query
from tidemark.session import materialize, scratch_path
from tidemark.sources import customers as C
from tidemark.sources import tables as TB
from tidemark.streaming import jobs

RECALL = 0.9


def _embeddings(spark, base):
    return TB.table(spark, base, "embeddings").select(
        F.lit("").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def index_recall(spark, base):
    """An index over all embeddings, searched by all of them: what it finds and compares, against the exact join."""
    df = _embeddings(spark, base)
    refs, queries = df.withColumnRenamed("id", "rid"), df.withColumnRenamed("id", "qid")
    index = KI.calibrate(KI.build(refs), queries, exclude_self=True)
    exact = materialize(K.knn_join(queries, refs, exclude_self=True), "knn-exact")
    return KI.recall(index, queries, exact, exclude_self=True)


@query("knn_index_recall")
def knn_index_recall(spark, base):
    return index_recall(spark, base).withColumn("compared_share", F.col("compared") / (F.col("queries") * F.col("refs")))


@query("knn_index", sql="""
SELECT '' AS grp, count(*) AS queries, count(*) AS refs, true AS recall_reached, true AS under_half FROM embeddings""")
def knn_index(spark, base):
    found = index_recall(spark, base)
    return found.select("grp", "queries", "refs", (F.col("recall") >= RECALL).alias("recall_reached"),
                        (F.col("compared") * 2 < F.col("queries") * F.col("refs")).alias("under_half"))


@query("knn_index_exact", ctes=("nb",), sql="SELECT * FROM nb")
def knn_index_exact(spark, base):
    """The index of each industry's customers with all lists searched, which is the exact join."""
    df = scaled_customers(spark, base)
    q = K.vectors(df.where(F.col("split") == "test"), "customer_id", SCALED, "industry", "qid")
    r = K.vectors(df.where(F.col("split") == "train"), "customer_id", SCALED, "industry", "rid")
    return KI.search(KI.build(r), q)


def ecommerce_state(spark, base, **how) -> serving.ServingState:
    return serving.fit_state("ecommerce", SQ.reference_rows(spark, base, "train"), SQ.reference_rows(spark, base, "val"),
                             SQ.ecommerce_risk, SQ.EC_KNN, **how)


@query("score_batch_saved", ctes=("ec_out",), sql=SQ.DECISIONS)
def score_batch_saved(spark, base):
    """The decision report from a published state: what is read back fits nothing, and says what fitting and scoring said."""
    store = Store(spark, scratch_path(spark, "serving-store"))
    serving.publish_state(store, ecommerce_state(spark, base, indexed=True), "first")
    state = serving.load_state(store, SQ.ecommerce_risk)
    return SQ.decisions_of(serving.score_with(state, SQ.uploaded_batch(spark, base))[1])


SPLIT = "(count(*) * 20 + 99) // 100 AS val"


@query("augment_commit", ctes=("c360",), sql=f"""
WITH s AS (SELECT CAST(sum(n - val) AS BIGINT) AS t, CAST(sum(val) AS BIGINT) AS v FROM (
    SELECT churned, count(*) AS n, {SPLIT} FROM c360 WHERE split <> 'test' GROUP BY churned)),
a AS (SELECT CAST(sum(n - val) AS BIGINT) AS t, CAST(sum(val) AS BIGINT) AS v FROM (
    SELECT churned, count(*) AS n, {SPLIT} FROM c360 WHERE split = 'test' GROUP BY churned))
SELECT step, version, CASE WHEN grown THEN s.t + a.t ELSE s.t END AS train_rows, CASE WHEN grown THEN s.v + a.v ELSE s.v END AS val_rows
FROM s, a, (VALUES ('1 start', 1, false), ('2 april', 2, true), ('3 april again', 2, true), ('4 rejected', 2, true), ('5 rolled back', 3, false))
  AS x(step, version, grown)""")
def augment_commit(spark, base):
    """Labelled uploads refit and publish a store's model; a replayed, a rejected and a rolled back one change no rows."""
    df = C.feature_table(spark, base).drop("industry")
    old, new = df.where("split <> 'test'").drop("split"), df.where("split = 'test'").drop("split")
    store, steps = Store(spark, scratch_path(spark, "training-store")), []

    def note(step: str) -> None:
        version = store.current()
        rows = L.training_rows(store, version)
        steps.append(rows.agg(F.count(F.when(F.col("part") == "train", 1)).alias("train_rows"),
                              F.count(F.when(F.col("part") == "val", 1)).alias("val_rows"))
                     .select(F.lit(step).alias("step"), F.lit(version.number).alias("version"), "train_rows", "val_rows"))

    def add(upload, batch: str, **how) -> None:
        L.augment_store(store, upload, "spring.csv", "ecommerce", "customer_id", batch, SQ.EC_KNN, folds=2, **how)

    add(old, "march")
    note("1 start")
    add(new, "april")
    note("2 april")
    add(old, "april")
    note("3 april again")
    try:
        add(old, "may", params={"maxIter": 2, "numTrees": 2}, tolerance=-1.0)
    except CF.CalibrationQualityError:
        note("4 rejected")
    store.rollback(1)
    note("5 rolled back")
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    return out


def landed_csv(spark, base) -> tuple[str, object]:
    """The uploaded batch as CSV files with a few broken lines among them: (folder, schema)."""
    batch, folder = SQ.uploaded_batch(spark, base), scratch_path(spark, "landed")
    batch.repartition(3).write.option("header", "true").csv(folder)
    broken = [(",".join(batch.columns),), ("1,2",), ("x" * 50 + "," * 40,)]
    spark.createDataFrame(broken, "line string").coalesce(1).write.mode("append").text(folder)
    return folder, batch.schema


@query("stream_decisions", ctes=("ec_out",), sql=SQ.DECISIONS)
def stream_decisions(spark, base):
    """CSV files as they arrive, scored by the published state: the same rows as the decision report of a batch."""
    folder, schema = landed_csv(spark, base)
    store = Store(spark, scratch_path(spark, "serving-store"))
    serving.publish_state(store, ecommerce_state(spark, base), "first")
    out = scratch_path(spark, "decided")
    jobs.decide_arriving(jobs.arriving_csv(spark, folder, schema, files_per_batch=2), serving.load_state(store, SQ.ecommerce_risk),
                         list(SQ.UPLOAD), f"{out}/rows", f"{out}/quarantine", f"{out}/checkpoint")
    return SQ.shown(spark.read.parquet(f"{out}/rows").drop("batch_id"))


@query("stream_first_labels", ctes=("c360",), sql="SELECT industry, churned, count(*) AS n FROM c360 GROUP BY industry, churned")
def stream_first_labels(spark, base):
    """Labels as they arrive, and then again with the other label: the first of each customer counts."""
    rows = C.feature_table(spark, base).select("customer_id", "industry", "churned")
    out = scratch_path(spark, "labels")
    found = None
    for landing in (rows, rows.withColumn("churned", 1 - F.col("churned")).unionByName(rows)):
        landing.write.mode("append").parquet(f"{out}/in")
        stream = jobs.arriving(spark, f"{out}/in", rows.schema)
        found = jobs.first_labels(stream, "customer_id", ["industry", "churned"], f"{out}/first", f"{out}/checkpoint")
    return found
