"""Calibration rows are scored once, however many passes the quantiles take."""

from pyspark.sql import functions as F

from tidemark.operators import lifecycle as L
from tidemark.operators import serving


def rows_of(spark, n):
    return spark.range(n).select(F.col("id").alias("customer_id"), (F.col("id") % 2).cast("int").alias("churned"),
                                 (F.col("id") % 48).cast("int").alias("tenure_months"))


def test_fitting_a_state_scores_each_calibration_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def p_of(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch.assign(p=(batch.customer_id % 100) / 100.0)

    scorer = lambda df, name: df.mapInPandas(p_of, "customer_id bigint, churned int, tenure_months int, p double")
    state = serving.fit_state("ecommerce", rows_of(spark, 50), rows_of(spark, 400), scorer, ["tenure_months"])
    assert {r.n for r in state.quantiles.collect()} == {400}
    assert seen.value == 400


def test_augmentation_takes_the_scores_of_its_refit(spark, monkeypatch, tmp_path):
    rows, fitted = rows_of(spark, 300), []

    class Model:
        def __call__(self, df, name):
            raise AssertionError("the calibration rows are scored a second time")

    def refit(industry, train, val, key, **how):
        scored = val.select("churned", F.lit(0.5).alias("p"), F.lit(industry).alias("industry"))
        return L.Refitted(Model(), None, scored)

    monkeypatch.setattr(L, "refit", refit)
    monkeypatch.setattr(L.serving, "publish_state", lambda store, state, *how: fitted.append(state))
    L.augment_store(L.Store(spark, str(tmp_path / "store")), rows, "a.csv", "ecommerce", "customer_id", "b", ["tenure_months"])
    assert {r.n for r in fitted[0].quantiles.collect()} == {60}
