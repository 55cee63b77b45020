import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import knn as K
from tidemark.operators import lifecycle as L
from tidemark.operators import models as MD
from tidemark.operators import survival as SV
from tidemark.operators.conformal import CalibrationQualityError
from tidemark.sources import customers as C

QUICK = {"maxIter": 2, "maxDepth": 2, "stepSize": 0.1, "subsamplingRate": 1.0, "numTrees": 3}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 3)), 2)
    x[::3] = x[0]  # a third of the points are copies
    return spark.createDataFrame([("a" if i % 5 else "b", i, [float(v) for v in x[i]]) for i in range(600)],
                                 "grp string, id bigint, vec array<double>").cache()


@pytest.mark.parametrize("exclude_self", [False, True])
def test_tiled_and_broadcast_joins_equal_brute_force(points, exclude_self):
    q, r = points.where("id % 4 = 1 or id = 0").withColumnRenamed("id", "qid"), points.withColumnRenamed("id", "rid")
    near = K.knn_join(q, r, 5, exclude_self)
    tiled = K.knn_join(q, r, 5, exclude_self, broadcast_values=100, tile_rows=64)
    rows = points.collect()
    want = set()
    for a in rows:
        if a.id % 4 == 1 or a.id == 0:
            d = sorted((np.floor(np.sqrt(sum((u - v) ** 2 for u, v in zip(a.vec, b.vec))) * 1e6 + .5) / 1e6, b.id)
                       for b in rows if b.grp == a.grp and not (exclude_self and a.id == b.id))
            want |= {(a.id, rid, dist, i + 1) for i, (dist, rid) in enumerate(d[:5])}
    for got in (near, tiled):
        assert {(x.qid, x.rid, x.dist, x["rank"]) for x in got.collect()} == want


def test_cox_solves_its_score_equation(spark):
    rng = np.random.default_rng(2)
    n = 400
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(20 * np.exp(-0.8 * x[:, 0]))).astype(int)
    rows = [("g", int(t[i]), int(rng.random() < 0.7), float(x[i, 0]), float(x[i, 1]), 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, tenure_months int, churned int, a double, b double, flat double")
    out = {r.covariate: r for r in SV.cox_fit(df, "g", ["a", "b", "flat"]).collect()}
    assert set(out) == {"a", "b"} and out["a"].coef > 0.2 and out["a"].p < 0.001
    # Row-by-row Efron gradient with the penalty vanishes at the solution.
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    beta = np.array([out[c].coef for c in "ab"]) * x.std(axis=0, ddof=1)
    event = np.array([r[2] for r in rows])
    e = np.exp(z @ beta)
    grad = -n * SV.PENALIZER * beta
    for u in np.unique(t):
        risk, died = t >= u, (t == u) & (event == 1)
        d = died.sum()
        grad += z[died].sum(axis=0)
        for m in range(d):
            s0 = e[risk].sum() - m / d * e[died].sum()
            grad -= ((e[risk, None] * z[risk]).sum(axis=0) - m / d * (e[died, None] * z[died]).sum(axis=0)) / s0
    assert np.abs(grad).max() < 1e-5


def test_risk_sets(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 0), ("g", 2, 1), ("g", 5, 0)], "g string, tenure_months int, churned int")
    got = [(r.duration, r.events, r.at_risk) for r in SV.risk_sets(df, ["g"]).orderBy("duration").collect()]
    assert got == [(1, 1, 4), (2, 1, 3), (5, 0, 1)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        tenure, spend = int(rng.integers(1, 60)), float(rng.normal(100, 25))
        p = 1 / (1 + np.exp(0.08 * (tenure - 30)))
        rows.append((i, tenure, spend, ["North", "South"][i % 2], int(rng.integers(0, 2)), int(rng.random() < p)))
    return spark.createDataFrame(rows, "customer_id bigint, tenure_months int, monthly_spend_usd double, region string, autopay_enabled int, churned int").cache()


def test_stack_scores_and_round_trips(labelled, tmp_path):
    model = MD.fit_stack(labelled, ["tenure_months", "monthly_spend_usd"], ["region"], "customer_id", folds=2, params=QUICK)
    scored = model.probabilities(labelled)
    assert scored.columns == [*labelled.columns, "p"]
    assert MD.auc_of(scored, "p", "churned") > 0.7
    assert sum(v for _, v in model.importances()) == pytest.approx(1.0)
    model.save(str(tmp_path / "stack"))
    again = MD.StackedModel.load(str(tmp_path / "stack")).probabilities(labelled)
    gap = scored.alias("a").join(again.alias("b"), "customer_id").agg(F.max(F.abs(F.col("a.p") - F.col("b.p")))).first()[0]
    assert gap < 1e-9


def test_rows_of_many_fits_lie_in_as_few_partitions_as_they_need(labelled, monkeypatch):
    def prepared():
        return MD.prepare(labelled, ["tenure_months", "monthly_spend_usd"], ["region"], "customer_id", folds=2)

    cores = labelled.sparkSession.sparkContext.defaultParallelism
    few = prepared()
    assert few.rows.rdd.getNumPartitions() == 1 and few.threads == max(MD.FITS, 2 * cores) and few.rows.count() == 400
    monkeypatch.setattr(session, "PASS_ROWS", 10)
    many = prepared()
    assert many.rows.rdd.getNumPartitions() % cores == 0 and many.threads == MD.FITS and many.rows.count() == 400


def test_augment_commits_only_after_the_guardrail(spark, labelled, tmp_path):
    path = str(tmp_path / "base")
    labelled.withColumn("part", F.when(F.col("customer_id") % 4 == 0, "val").otherwise("train")).write.partitionBy("part").parquet(path)
    upload = labelled.limit(50).withColumn("customer_id", F.col("customer_id") + 1000).withColumn(
        "churned", F.when(F.col("churned") == 1, "Exited").otherwise("retained"))

    def reject(train, val):
        raise CalibrationQualityError("too far off")

    base = spark.read.parquet(path)
    with pytest.raises(CalibrationQualityError):
        L.augment(path, upload, "march_train.csv", "retail", "customer_id", reject)
    assert spark.read.parquet(path).count() == base.count() == 400
    counts, _ = L.augment(path, upload, "march.csv", "retail", "customer_id", lambda train, val: None)
    assert counts["train_records_added"] + counts["val_records_added"] == 50
    assert spark.read.parquet(path).count() == 450


def test_training_isolates_failures():
    done, failed = L.train_all(["retail", "saas"], lambda i: 1 / 0 if i == "saas" else i)
    assert done == {"retail": "retail"} and "ZeroDivisionError" in failed["saas"]


def test_feature_table_is_stored_once(spark, base):
    first, second = C.feature_table(spark, base), C.feature_table(spark, base)
    assert first.inputFiles() == second.inputFiles()
    assert first.count() == C.customer_360(spark, base).count()


def test_cross_validated_search_reports_every_trial(labelled):
    space = {k: [v] for k, v in QUICK.items()}
    best, trials = MD.tune_cv(labelled, ["tenure_months", "monthly_spend_usd"], ["region"], "customer_id",
                              trials=1, folds=2, space=space)
    assert best == QUICK and len(trials) == 1 and len(trials[0]["folds"]) == 2 and trials[0]["auc"] > 0.6
