"""Ordered target statistics and the Cox sums against plain loops."""

import hashlib

import numpy as np
from pyspark.ml import PipelineModel

from tidemark.operators import models as MD
from tidemark.operators import survival as SV
from tidemark.operators import target_stats as TS


def key_hash(k):
    return int(hashlib.md5(str(k).encode()).hexdigest()[:13], 16)


def test_ordered_statistics(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else "rare", "xyz"[i * 7 % 3], i * 31 % 5 % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, c string, d string, y int")
    prior = sum(r[3] for r in rows) / len(rows)
    want = {}
    for col in (1, 2):
        seen = {}
        for r in sorted(rows, key=lambda r: (key_hash(r[0]), r[0])):
            s, n = seen.get(r[col], (0, 0))
            want[r[0], col] = (s + prior) / (n + 1)
            seen[r[col]] = (s + r[3], n + 1)
    for range_rows in (7, 4096):
        got = TS.ordered(df, "id", ["c", "d"], "y", range_rows=range_rows).collect()
        assert len(got) == 300
        assert all(abs(r.ts_c - want[r.id, 1]) < 1e-12 and abs(r.ts_d - want[r.id, 2]) < 1e-12 for r in got)


def test_ordered_learner_does_not_learn_its_own_labels(spark, tmp_path):
    """A category of one row each tells nothing: seen with its own label it would tell everything."""
    rng = np.random.default_rng(3)
    rows = [(i, f"level{i}", float(rng.normal()), int(rng.integers(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, c string, x double, y int")
    p = {**MD.REFIT, "maxIter": 5, "maxDepth": 3}
    model = MD.learner("encoded", ["x"], ["c"], "y", p, "id").fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    fresh = spark.createDataFrame([(1000, "unseen", 0.0), (1001, None, 0.0)], "id bigint, c string, x double")
    a, b = (MD.add_probability(m, fresh, "encoded").orderBy("id").collect() for m in (model, again))
    assert a == b and a[0].p_encoded == a[1].p_encoded
    known = MD.add_probability(model, df, "encoded")
    assert MD.auc_of(known, "p_encoded", "y") < 0.8


def test_cox_of_two_groups_has_the_closed_form(spark):
    """One binary covariate, every subject an event, two distinct times: the root of the score is found by hand."""
    rows = [("g", 1, 1, 1.0)] * 30 + [("g", 1, 1, 0.0)] * 10 + [("g", 2, 0, 1.0)] * 20 + [("g", 2, 0, 0.0)] * 40 + [(None, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, tenure_months int, churned int, x double")
    out = SV.cox_fit(df, "g", ["x"], penalizer=0.0).collect()
    assert len(out) == 1 and out[0].converged

    def score(b):  # Efron: forty events at time 1, all hundred at risk
        e = np.exp(b)
        f = np.arange(40) / 40
        s0 = (50 * e + 50) - f * (30 * e + 10)
        return 30 - ((50 * e - f * 30 * e) / s0).sum()

    low, high = -5.0, 5.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if score(mid) > 0 else (low, mid)
    assert abs(out[0].coef - low) < 1e-6
