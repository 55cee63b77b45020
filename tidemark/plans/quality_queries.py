"""Model quality and conformal diagnostics on the scored customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import action_tier, level_from_text, set_label, stable_round, suggested_action
from tidemark.operators import conformal as CF
from tidemark.operators import metrics as M
from tidemark.plans import common  # noqa: F401
from tidemark.plans.registry import define_cte, query, rnd
from tidemark.sources import customers as C

LEVELS = ", ".join(f"({x})" for x in catalog.LEVELS_PCT)
P0 = rnd("1 - p", 6)

define_cte("quant", f"""
SELECT industry, level_pct, n, k, coalesce(max(CASE WHEN rn = k THEN s END), 1.0::DOUBLE) AS qhat FROM (
  SELECT industry, s, n, rn, level_pct, ((n + 1) * level_pct + 99) // 100 AS k FROM (
    SELECT industry, {rnd(f'1 - CASE WHEN churned = 1 THEN p ELSE {P0} END', 6)} AS s,
      row_number() OVER (PARTITION BY industry ORDER BY {rnd(f'1 - CASE WHEN churned = 1 THEN p ELSE {P0} END', 6)}) AS rn,
      count(*) OVER (PARTITION BY industry) AS n
    FROM scored WHERE split = 'val'), (VALUES {LEVELS}) AS l(level_pct))
GROUP BY industry, level_pct, n, k""", "scored")
define_cte("sets", f"""
SELECT scored.*, level_pct, qhat, {P0} >= {rnd('1 - qhat', 6)} AS in0, p >= {rnd('1 - qhat', 6)} AS in1
FROM scored JOIN quant USING (industry)""", "quant", "scored")


def quantiles(spark, base):
    return CF.calibrate(C.scored_customers(spark, base).where(F.col("split") == "val"), ["industry"])


def sets(spark, base, split="test", level_pct=None):
    scored = C.scored_customers(spark, base)
    if split:
        scored = scored.where(F.col("split") == split)
    return CF.prediction_sets(scored, quantiles(spark, base), ["industry"], level_pct=level_pct)


def test_rows(spark, base):
    return C.scored_customers(spark, base).where(F.col("split") == "test")


@query("scored_customers", ctes=("scored",), sql="SELECT * FROM scored")
def scored_customers(spark, base):
    return C.scored_customers(spark, base)


@query("accuracy", ctes=("scored",), sql=f"""
SELECT industry, count(*) AS n, {rnd('avg(CASE WHEN (p >= 0.5) = (churned = 1) THEN 1 ELSE 0 END)', 6)} AS accuracy
FROM scored WHERE split = 'test' GROUP BY industry""")
def accuracy(spark, base):
    return M.accuracy(test_rows(spark, base), ["industry"]).withColumn("accuracy", stable_round(F.col("accuracy"), 6))


AUC = """SELECT industry, (sum(CASE WHEN churned = 1 THEN rk END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS roc_auc FROM (
  SELECT industry, churned, rank() OVER (PARTITION BY industry ORDER BY p) + (count(*) OVER (PARTITION BY industry, p) - 1) / 2.0 AS rk,
    sum(churned) OVER (PARTITION BY industry)::DOUBLE AS n1, sum(1 - churned) OVER (PARTITION BY industry)::DOUBLE AS n0
  FROM scored WHERE split = 'test') WHERE n1 > 0 AND n0 > 0 GROUP BY industry, n1, n0"""


@query("roc_auc", ctes=("scored",), sql=f"SELECT industry, {rnd('roc_auc', 6)} AS roc_auc FROM ({AUC})")
def roc_auc(spark, base):
    out = M.roc_auc(test_rows(spark, base), ["industry"])
    return out.where(F.col("roc_auc").isNotNull()).withColumn("roc_auc", stable_round(F.col("roc_auc"), 6))


@query("eval_by_industry", ctes=("scored",), sql=f"""
WITH e AS (SELECT industry, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (churned = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, any_value(roc_auc) AS roc_auc
  FROM scored LEFT JOIN ({AUC}) USING (industry) WHERE split = 'test' GROUP BY industry)
SELECT industry, n, {rnd('accuracy', 6)} AS accuracy, {rnd('roc_auc', 6)} AS roc_auc FROM e
UNION ALL SELECT 'Mean', CAST(sum(n) AS BIGINT), {rnd('avg(accuracy)', 6)}, {rnd('avg(roc_auc)', 6)} FROM e""")
def eval_by_industry(spark, base):
    # Features and answer key meet on the customer id, as separate files would.
    rows = test_rows(spark, base)
    features = rows.drop("churned")
    answers = rows.select("customer_id", "churned")
    return M.evaluate(features.join(answers, "customer_id")).withColumns({
        c: stable_round(F.col(c), 6) for c in ("accuracy", "roc_auc")})


@query("brier_score", ctes=("scored",), sql=f"""
SELECT industry, {rnd('avg(power(p - churned, 2))', 6)} AS brier_score, {rnd('(1 - avg(power(p - churned, 2))) * 100', 1)} AS calibration_score
FROM scored WHERE split = 'test' GROUP BY industry""")
def brier_score(spark, base):
    return M.brier(test_rows(spark, base), ["industry"]).withColumns({
        "brier_score": stable_round(F.col("brier_score"), 6),
        "calibration_score": stable_round(F.col("calibration_score"), 1)})


@query("classification_report", ctes=("scored",), sql=f"""
WITH c AS (SELECT y, sum(CASE WHEN churned = y AND pred = y THEN 1 ELSE 0 END)::DOUBLE AS hit, sum(CASE WHEN churned = y THEN 1 ELSE 0 END)::DOUBLE AS support,
    sum(CASE WHEN pred = y THEN 1 ELSE 0 END)::DOUBLE AS predicted
  FROM (SELECT churned, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored WHERE split = 'test'), (VALUES (0), (1)) AS v(y) GROUP BY y),
r AS (SELECT y, support, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r)
SELECT CAST(y AS VARCHAR) AS class, {rnd('pr', 6)} AS precision, {rnd('re', 6)} AS recall, {rnd('f1', 6)} AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', {rnd('avg(pr)', 6)}, {rnd('avg(re)', 6)}, {rnd('avg(f1)', 6)}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {rnd('sum(pr * support) / sum(support)', 6)}, {rnd('sum(re * support) / sum(support)', 6)}, {rnd('sum(f1 * support) / sum(support)', 6)}, CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, base):
    out = M.classification_report(test_rows(spark, base))
    return out.withColumns({m: stable_round(F.col(m), 6) for m in ("precision", "recall", "f1")})


@query("conformal_quantiles", ctes=("quant",), sql="SELECT * FROM quant")
def conformal_quantiles(spark, base):
    return quantiles(spark, base)


@query("conformal_sets", ctes=("sets",), sql="SELECT customer_id, level_pct, in0, in1 FROM sets WHERE split = 'test'")
def conformal_sets(spark, base):
    return sets(spark, base).select("customer_id", "level_pct", "in0", "in1")


COVERAGE = "avg(CASE WHEN churned = 1 THEN in1 ELSE in0 END::INTEGER)"


@query("conformal_coverage", ctes=("sets",), sql=f"""
SELECT industry, level_pct, count(*) AS n, {rnd(COVERAGE, 6)} AS coverage, {rnd('avg(in0::INTEGER + in1::INTEGER)', 6)} AS avg_set_size
FROM sets WHERE split = 'test' GROUP BY industry, level_pct""")
def conformal_coverage(spark, base):
    return CF.coverage(sets(spark, base), ["industry"]).withColumns({
        c: stable_round(F.col(c), 6) for c in ("coverage", "avg_set_size")})


DIST = """SELECT industry, level_pct, count(CASE WHEN in0 AND NOT in1 THEN 1 END) AS retained,
  count(CASE WHEN in1 AND NOT in0 THEN 1 END) AS churned, count(CASE WHEN in0 = in1 THEN 1 END) AS uncertain
FROM sets WHERE split = 'test' GROUP BY industry, level_pct"""


@query("conformal_set_distribution", ctes=("sets",), sql=DIST)
def conformal_set_distribution(spark, base):
    return CF.set_distribution(sets(spark, base), ["industry"])


@query("business_impact", ctes=("sets",), sql=f"""
SELECT industry, level_pct, retained, churned, uncertain, (churned + uncertain) * 50 AS outreach_cost,
  churned * 200 + uncertain * 50 AS saved_value, churned * 200 + uncertain * 50 - (churned + uncertain) * 50 AS net_benefit FROM ({DIST})""")
def business_impact(spark, base):
    return CF.business_impact(CF.set_distribution(sets(spark, base), ["industry"]))


@query("confident_rate", ctes=("sets",), sql=f"""
SELECT industry, split, level_pct, {rnd('avg(CASE WHEN in0 <> in1 THEN 1.0::DOUBLE ELSE 0 END) * 100', 2)} AS confident_rate
FROM sets WHERE split IN ('train', 'val') GROUP BY industry, split, level_pct""")
def confident_rate(spark, base):
    rows = sets(spark, base, split=None).where(F.col("split").isin("train", "val"))
    return CF.confident_rate(rows, ["industry", "split"]).withColumn(
        "confident_rate", stable_round(F.col("confident_rate"), 2))


@query("calibration_guardrail", ctes=("sets",), sql=f"""
SELECT industry, level_pct, n, {rnd('coverage', 6)} AS coverage, {rnd('abs(coverage - level_pct / 100.0::DOUBLE)', 6)} AS deviation,
  {rnd('abs(coverage - level_pct / 100.0::DOUBLE)', 9)} <= 0.05::DOUBLE AS passed
FROM (SELECT industry, level_pct, count(*) AS n, {COVERAGE} AS coverage FROM sets WHERE split = 'val' GROUP BY industry, level_pct)""")
def calibration_guardrail(spark, base):
    out = CF.guardrail(CF.coverage(sets(spark, base, "val"), ["industry"])).drop("avg_set_size")
    return out.withColumns({c: stable_round(F.col(c), 6) for c in ("coverage", "deviation")})


TIER = """CASE WHEN in0 AND in1 THEN 'Active Monitoring' WHEN in1 THEN 'Action Required' WHEN in0 THEN 'No Intervention'
  ELSE 'Active Monitoring (Uncertain Profile)' END"""


@query("action_tier", ctes=("sets",), sql=f"""
SELECT customer_id, level_pct, CASE WHEN in1 AND NOT in0 THEN 'Churned' WHEN in0 AND NOT in1 THEN 'Retained' ELSE 'Retained, Churned' END AS prediction_set,
  {TIER} AS action, CASE WHEN p * 100 >= 50 THEN 'Yes' ELSE 'No' END AS prediction,
  CASE WHEN {TIER} = 'Action Required' THEN 'Suggested Action: Trigger high-value outreach.'
    WHEN {TIER} LIKE 'Active Monitoring%' THEN 'Suggested Action: Deploy success check-in.' ELSE 'Suggested Action: No intervention budget spent.' END AS recommendation
FROM sets WHERE split = 'test' AND level_pct = CASE customer_id % 6 WHEN 0 THEN 80 WHEN 1 THEN 85 WHEN 2 THEN 90 WHEN 3 THEN 95 ELSE 85 END""")
def action_tier_query(spark, base):
    # The requested level arrives as text; unknown or malformed requests mean 85 %.
    asked = F.element_at(F.array(*[F.lit(x) for x in ("0.80", "0.85", "0.9", "0.95", "0.77", "high")]),
                         (F.col("customer_id") % 6 + 1).cast("int"))
    rows = sets(spark, base).where(F.col("level_pct") == level_from_text(asked))
    tier = action_tier(F.col("in0"), F.col("in1"))
    return rows.select(
        "customer_id", "level_pct", set_label(F.col("in0"), F.col("in1")).alias("prediction_set"),
        tier.alias("action"), F.when(F.col("p") * 100 >= 50, "Yes").otherwise("No").alias("prediction"),
        suggested_action(tier).alias("recommendation"))
