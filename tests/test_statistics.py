import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import conformal as CF
from tidemark.operators import metrics as M
from tidemark.operators import preprocess as PP
from tidemark.operators import selection as SEL
from tidemark.operators import splitting as SP
from tidemark.operators.impute import CorrelationImputer


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    # A third of all rows share one value; one group holds most rows.
    rows = [("hot" if i % 4 else "cold", i, 5.0 if i % 3 == 0 else rng.random() * 10, None if i % 10 == 0 else float(i % 17))
            for i in range(4000)]
    return spark.createDataFrame(rows, "g string, id bigint, x double, y double").cache()


def test_bracketed_order_statistics_equal_sorting(skewed):
    rows = skewed.collect()
    targets = {"p10": (0.1, lambda n: F.ceil(n * 0.1)), "p85": (0.85, lambda n: F.ceil((n + 1) * 0.85))}
    # Small sketches force the bracket path: 100 values are the most that may be ranked whole.
    got = SEL.order_statistics(skewed, ["x", "y"], ["g"], targets, small=100, accuracy=200).collect()
    for r in got:
        values = sorted(v[r["column"]] for v in rows if v.g == r.g and v[r["column"]] is not None)
        n = len(values)
        k = int(np.ceil(n * 0.1)) if r.target == "p10" else int(np.ceil((n + 1) * 0.85 - 1e-9))
        assert (r.n, r.value) == (n, values[k - 1])


def test_medians_and_modes(skewed):
    got = {(r.g, r["column"]): r.median for r in SEL.medians(skewed, ["x", "y"], ["g"], small=50, accuracy=100).collect()}
    rows = skewed.collect()
    for (g, c), m in got.items():
        assert m == pytest.approx(float(np.median([v[c] for v in rows if v.g == g and v[c] is not None])))
    df = skewed.sparkSession.createDataFrame([("a",), ("b",), (None,)], "c string").withColumn("k", F.lit(1))
    assert SEL.modes(df, ["c"], ["k"]).first().mode == "a"


def test_ordinal_is_a_permutation(skewed):
    rows = SEL.ordinal(skewed.select("id"), "id", buckets=7).orderBy("id").collect()
    assert [r.ordinal for r in rows] == list(range(1, 4001))


def test_auc_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [("g", round(rng.random(), 1), rng.randint(0, 1)) for _ in range(300)] + [("one", 0.4, 1)]
    got = {r.g: r.roc_auc for r in M.roc_auc(spark.createDataFrame(rows, "g string, p double, churned int"), ["g"]).collect()}
    pos, neg = [r[1] for r in rows[:300] if r[2]], [r[1] for r in rows[:300] if not r[2]]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got["g"] == pytest.approx(want) and got["one"] is None


def test_stratified_parts_have_exact_sizes(skewed):
    df = skewed.select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    counts = {(r.y, r.part): r["count"] for r in SP.stratified_split_3way(df, "id", "y").groupBy("y", "part").count().collect()}
    for y, n in ((1, 1334), (0, 2666)):
        assert counts[y, "train"] == -(-n * 70 // 100)
        assert counts[y, "train"] + counts[y, "val"] == -(-n * 85 // 100)
    folds = {r.fold: r["count"] for r in SP.kfold(df, "id", "y", 5).groupBy("fold").count().collect()}
    assert sum(folds.values()) == 4000 and max(folds.values()) - min(folds.values()) <= 2
    again = SP.kfold(df.repartition(7), "id", "y", 5)
    assert again.exceptAll(SP.kfold(df, "id", "y", 5)).count() == 0


def test_preprocessor_matches_numpy_and_survives_saving(skewed, tmp_path):
    model = PP.Preprocessor(numericCols=["x", "y"], categoricalCols=["g"]).fit(skewed)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = PP.PreprocessorModel.load(str(tmp_path / "m")).transform(skewed).orderBy("id").toPandas()
    raw = skewed.orderBy("id").toPandas()
    y = raw.y.fillna(raw.y.median())
    assert np.allclose(out.y, (y - y.mean()) / y.std(ddof=0))


def test_imputer_equals_closed_form_ridge(spark):
    rng = np.random.default_rng(0)
    n = 200
    t, s, o = rng.integers(1, 60, n).astype(float), rng.normal(100, 20, n), rng.integers(0, 9, n).astype(float)
    v = 3.0 * t - 0.5 * s + rng.normal(0, 1, n) + 200
    rows = [(float(a), float(b), float(c), float(d), "West") for a, b, c, d in zip(t, s, o, v)]
    train = spark.createDataFrame(rows, "tenure_months double, monthly_spend_usd double, orders_180d double, avg_order_value_usd double, region string")
    imp = CorrelationImputer("ecommerce").fit(train)
    values, sources = imp.impute(["tenure_months", "monthly_spend_usd"], ["avg_order_value_usd", "region", "age", "orders_180d"])
    assert sources == {"avg_order_value_usd": "correlation", "region": "training_mode", "age": "static_default", "orders_180d": "correlation"}
    x = np.c_[t, s, o]
    xc = x - x.mean(axis=0)
    beta = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (v - v.mean()))
    given = np.c_[t, s, np.full(n, np.median(o))]
    want = np.clip(v.mean() + (given - x.mean(axis=0)) @ beta, 0, None)
    got = train.select(values["avg_order_value_usd"].alias("z"), values["orders_180d"].alias("o")).toPandas()
    assert np.allclose(got.z, want) and got.o.dtype.kind == "i" and (got.o >= 0).all()


@pytest.mark.parametrize("n", [4, 19, 180])
def test_conformal_rank_at_the_edges(spark, n):
    rows = [("g", (i + 1) / 1000.0, 0) for i in range(n)]
    df = spark.createDataFrame(rows, "industry string, p double, churned int")
    for r in CF.calibrate(df, ["industry"]).collect():
        k = -(-(n + 1) * r.level_pct // 100)
        assert r.k == k and r.qhat == (1.0 if k > n else pytest.approx(k / 1000.0))


def test_guardrail_raises(spark):
    cover = spark.createDataFrame([("g", 90, 0.84)], "industry string, level_pct int, coverage double")
    with pytest.raises(CF.CalibrationQualityError):
        CF.require_guardrail(cover)
    CF.require_guardrail(cover.withColumn("coverage", F.lit(0.95)))


def test_calibration_set_is_covered_whatever_the_decimals(spark):
    rng = random.Random(11)
    rows = [("g", rng.random(), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "industry string, p double, churned int")
    sets = CF.prediction_sets(df, CF.calibrate(df, ["industry"]), ["industry"])
    for r in CF.coverage(sets, ["industry"]).collect():
        assert r.level_pct / 100 <= r.coverage <= r.level_pct / 100 + 0.01
