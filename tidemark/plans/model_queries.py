"""Fitted models, survival, ingestion, augmentation, streaming and the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars as S

from tidemark.operators import conformal as CF
from tidemark.operators import dashboard as DB
from tidemark.operators import lifecycle as L
from tidemark.operators import metrics as M
from tidemark.operators import models as MD
from tidemark.operators import preprocess as PP
from tidemark.operators import profile as P
from tidemark.operators import align as A
from tidemark.operators import serving
from tidemark.operators import survival as SV
from tidemark.operators import target_stats as TS
from tidemark.operators.bridge import FeatureBridge
from tidemark.plans import alignment_queries as AQ
from tidemark.plans import common  # noqa: F401
from tidemark.plans import scoring_queries as SQ
from tidemark.plans.quality_queries import AUC, COVERAGE, DIST, TIER, quantiles
from tidemark.plans.registry import query, rnd

from tidemark.session import materialize, scratch_path
from tidemark.sources import customers as C
from tidemark.sources import tables as TB
from tidemark.sources import uploads as U
from tidemark.streaming import jobs

NUM = ["tenure_months", "monthly_spend_usd", "discount_pct", "return_rate", "days_since_last_activity",
       "orders_180d", "avg_order_value_usd", "nps_score", "cart_abandon_rate"]
CAT = ["region", "customer_segment", "contract_type"]
_MODELS: dict[tuple, MD.StackedModel] = {}


def stacked(spark, base) -> MD.StackedModel:
    """The stacked model of the training customers, fitted once per feature table."""
    df = C.feature_table(spark, base)
    key = tuple(sorted(df.inputFiles()))
    if key not in _MODELS:
        train = df.where(F.col("split") == "train")
        _MODELS[key] = MD.fit_stack(train, NUM, CAT, "customer_id", folds=5)
    return _MODELS[key]


#: Area under the curve that a fitted model reaches at least on the rows it was fitted on.  The label of the
#: given tables hangs on the time of later orders, which no feature foretells, so unseen rows have no floor.
AUC_FLOOR = 0.6


def _one_learner(spark, base, name):
    """Probabilities of one learner for all customers."""
    df = C.feature_table(spark, base)
    ready = PP.Preprocessor(numericCols=NUM, categoricalCols=CAT).fit(df.where("split = 'train'")).transform(df)
    ready = ready.select("customer_id", "split", F.col("churned").cast("double").alias("churned"), *NUM, *CAT)
    train = ready.where("split = 'train'")
    model = MD.learner(name, NUM, CAT, "churned", MD.REFIT | {"maxBins": MD.bins_for(train, CAT)}, "customer_id").fit(train)
    return MD.add_probability(model, ready, name).withColumn("model", F.lit(name)).withColumnRenamed(f"p_{name}", "p")


def _stack_scores(spark, base):
    """Probabilities of the stack and its learners for all customers, long: (customer_id, split, churned, model, p)."""
    out = stacked(spark, base).probabilities(C.feature_table(spark, base), keep_base=True)
    renamed = out.withColumnsRenamed({f"p_{n}": n for n in MD.LEARNERS} | {"p": "stack"})
    return renamed.unpivot(["customer_id", "split", "churned"], [*MD.LEARNERS, "stack"], "model", "p")


def score_audit(scores):
    """What holds of any model's scores, by model and split: rows, range, and the floor on training rows."""
    rows = materialize(scores.select("model", "split", "churned", "p"), "scores")
    counts = rows.groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("p").between(0, 1)).alias("in_range"))
    # the combiner weighs out-of-fold scores, so it promises nothing on the rows of its learners
    auc = M.roc_auc(rows.where("split = 'train' and model <> 'stack'"), ["model", "split"]).select(
        "model", "split", (F.col("roc_auc") >= AUC_FLOOR).alias("above"))
    return counts.join(auc, ["model", "split"], "left").select(
        "model", "split", "n", "in_range", F.coalesce("above", F.lit(True)).alias("above_floor"))


def audit_sql(*models: str) -> str:
    listed = ", ".join(f"('{m}')" for m in models)
    return (f"SELECT model, split, count(*) AS n, true AS in_range, true AS above_floor FROM c360, (VALUES {listed}) AS m(model) "
            "GROUP BY model, split")


@query("gbt_scores", ctes=("c360",), sql=audit_sql("gbt"))
def gbt_scores(spark, base):
    return score_audit(_one_learner(spark, base, "gbt"))


@query("rf_scores", ctes=("c360",), sql=audit_sql("rf"))
def rf_scores(spark, base):
    return score_audit(_one_learner(spark, base, "rf"))


@query("stacking_scores", ctes=("c360",), sql=audit_sql(*MD.LEARNERS, "stack"))
def stacking_scores(spark, base):
    return score_audit(_stack_scores(spark, base))


@query("base_learner_accuracy", ctes=("c360",), sql="""
SELECT model, count(*) AS n, true AS recomputed FROM c360, (VALUES ('gbt'), ('rf'), ('encoded'), ('stack')) AS m(model)
WHERE split = 'test' GROUP BY model""")
def base_learner_accuracy(spark, base):
    rows = materialize(_stack_scores(spark, base).where("split = 'test'"), "scores")
    again = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(((F.col("p") >= 0.5).cast("int") == F.col("churned")).cast("int")).alias("hits"))
    return M.accuracy(rows, ["model"]).select("model", "accuracy").join(again, "model").select(
        "model", "n", (F.abs(F.col("accuracy") - F.col("hits") / F.col("n")) < 1e-9).alias("recomputed"))


@query("feature_importance", sql=f"""
SELECT CAST({len(NUM) + len(CAT)} AS BIGINT) AS features, CAST(1.0 AS DOUBLE) AS total, true AS in_range, CAST(10 AS BIGINT) AS shown""")
def feature_importance(spark, base):
    table = MD.importance_table(spark, stacked(spark, base))
    top = table.orderBy(F.col("importance").desc(), "feature").limit(10).agg(F.count(F.lit(1)).alias("shown"))
    return table.agg(F.count(F.lit(1)).alias("features"), S.stable_round(F.sum("importance"), 6).alias("total"),
                     F.bool_and(F.col("importance").between(0, 1)).alias("in_range")).join(top)


# --- serving with fitted models -------------------------------------------------
def _ecommerce(spark, base, split):
    df = C.feature_table(spark, base).where(F.col("split") == split)
    return A.clean_features(df, "ecommerce", ["customer_id", "churned"])


@query("score_batch_ml", ctes=("c360",), sql="""
SELECT count(*) AS n, true AS in_range, true AS has_evidence FROM c360""")
def score_batch_ml(spark, base):
    """The uploaded batch scored by the fitted stack, with sets, evidence and what-if."""
    train, val = _ecommerce(spark, base, "train"), _ecommerce(spark, base, "val")
    numeric, categorical = A.feature_types(train.columns, "ecommerce")
    model = MD.fit_stack(train, numeric, categorical, "customer_id", folds=3)
    _, scored = serving.score_upload(SQ.uploaded_batch(spark, base), train, val, model, SQ.EC_KNN)
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("p_final").between(0, 1) & F.col("p_opt_final").between(0, 1)).alias("in_range"),
        F.bool_and(F.size("sources") > 0).alias("has_evidence"))


_TS_ORDER = f"ORDER BY {common.key_hash('customer_id')}, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _ts_sql(c: str) -> str:
    w = f"OVER (PARTITION BY {c} {_TS_ORDER})"
    return rnd(f"(coalesce(sum(churned) {w}, 0) + prior) / (count(*) {w} + 1)", 9) + f" AS ts_{c}"


@query("ordered_statistics", ctes=("c360",), sql=f"""
SELECT customer_id, {', '.join(_ts_sql(c) for c in CAT)}
FROM (SELECT *, avg(churned) OVER () AS prior FROM c360 WHERE split = 'train')""")
def ordered_statistics(spark, base):
    """What the third learner sees of a training row's categories: the labels of the rows before it."""
    train = C.feature_table(spark, base).where("split = 'train'")
    out = TS.ordered(train, "customer_id", CAT, "churned")
    return out.select("customer_id", *[S.stable_round(F.col(f"ts_{c}"), 9).alias(f"ts_{c}") for c in CAT])


@query("bridge_proxy", ctes=("c360",), sql="""
SELECT count(*) AS n, count(DISTINCT CASE WHEN customer_id % 5 > 0 THEN customer_id // 3 END) AS ids,
  CAST(sum(CASE WHEN customer_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS without_id, true AS in_range, true AS blended, true AS reported FROM c360""")
def bridge_proxy(spark, base):
    """An upload of low overlap with a label: a proxy model on its own numbers is blended in, row by row, whatever the ids."""
    ids = F.when(F.col("customer_id") % 5 > 0, F.floor(F.col("customer_id") / 3))  # repeated and missing ones
    upload = C.feature_table(spark, base).select(
        ids.alias("Customer_ID"), F.col("region").alias("Region"), F.col("avg_balance_usd").alias("Zeta"),
        F.col("feature_adoption_score").alias("Kappa"), F.col("completion_rate").alias("Omikron"), F.col("churned").alias("Churn"))
    out = FeatureBridge("ecommerce", proxy=MD.train_proxy).transform(upload)
    main = F.lit(0.5)
    blended = S.blend_proxy(main, F.col(out.proxy_column), F.lit(out.overlap))
    report = out.report.select(F.col("proxy_model.used").alias("reported"))
    return out.df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("ids"),
        F.count(F.when(F.col("customer_id").isNull(), 1)).alias("without_id"),
        F.bool_and(F.col(out.proxy_column).between(0, 1)).alias("in_range"),
        F.bool_or(F.abs(blended - main) > 1e-6).alias("blended")).join(report)


def one_flag(spark, holds: bool):
    return spark.createDataFrame([(holds,)], "in_range boolean")


@query("actionable_weight", sql="SELECT true AS in_range")
def actionable_weight(spark, base):
    """Share of the importance that the industry's actionable feature holds."""
    weight = MD.actionable_weight(MD.importance_table(spark, stacked(spark, base)), "cart_abandon_rate")
    return one_flag(spark, 0 <= weight <= 100)


TRIALS = 3


def trial_rows(spark, found: MD.Trials):
    """Each trial with its AUC against the one that its hold-out probabilities give."""
    space = MD.SEARCH_SPACE
    own = spark.createDataFrame(
        [(t["trial"], t["auc"], t["pruned"], t["params"] == found.best,
          all(t["params"][n][k] in v for n in MD.LEARNERS for k, v in space[n].items()) and set(t["params"]) == set(space)) for t in found.done],
        "trial int, auc double, pruned boolean, chosen boolean, in_space boolean")
    again = M.roc_auc(found.scores, ["trial", "fold"], "p", "label").groupBy("trial").agg(
        F.avg("roc_auc").alias("again"), F.count(F.lit(1)).alias("folds"))
    return own.join(again, "trial").withColumn("recomputed", F.abs(F.col("auc") - F.col("again")) < 1e-9)


@query("tuning_trials", sql="""
SELECT CAST(range AS INTEGER) AS trial, CAST(1 AS BIGINT) AS folds, true AS in_space, true AS recomputed, false AS pruned, true AS best_is_chosen FROM range(3)""")
def tuning_trials(spark, base):
    train = C.feature_table(spark, base).where("split = 'train'")
    rows = trial_rows(spark, MD.search(train, NUM, CAT, "customer_id", trials=TRIALS, folds=3))
    top = rows.agg(F.max("again").alias("top"))
    return rows.join(top).select("trial", "folds", "in_space", "recomputed", "pruned",
                                 (~F.col("chosen") | (F.abs(F.col("again") - F.col("top")) < 1e-9)).alias("best_is_chosen"))


@query("proxy_scores", ctes=("c360",), sql=audit_sql("proxy"))
def proxy_scores(spark, base):
    df = C.feature_table(spark, base)
    scored, _ = MD.train_proxy(df.where("split = 'train'"), "churned", NUM, ["customer_id"], also=df)
    return score_audit(scored.join(df.select("customer_id", "split", "churned"), "customer_id").select(
        F.lit("proxy").alias("model"), "split", "churned", F.col("proxy_probability").alias("p")))


# --- survival ----------------------------------------------------------------
@query("risk_set_table", ctes=("c360",), sql="""
SELECT industry, duration, leaving, events, CAST(sum(leaving) OVER (PARTITION BY industry ORDER BY duration DESC) AS BIGINT) AS at_risk
FROM (SELECT industry, tenure_months AS duration, count(*) AS leaving, count(CASE WHEN churned = 1 THEN 1 END) AS events
  FROM c360 WHERE tenure_months IS NOT NULL GROUP BY 1, 2)""")
def risk_set_table(spark, base):
    return SV.risk_sets(C.feature_table(spark, base), ["industry"])


COX_NUM = [c for c in NUM if c != "tenure_months"] + ["avg_balance_usd", "support_tickets_90d", "app_sessions_30d"]
COX_CAT = ["region", "customer_segment", "contract_type", "loyalty_tier", "membership_level"]


def _hazards(spark, base):
    """All processed features, imputed, against tenure, in the industries with a survival target."""
    df = C.feature_table(spark, base).where(F.col("industry").isin(*catalog.SURVIVAL_INDUSTRIES))
    ready = PP.Preprocessor(numericCols=COX_NUM, categoricalCols=COX_CAT).fit(df).transform(df)
    levels = PP.category_levels(ready, COX_CAT)
    hot = PP.one_hot(ready, levels, drop_first=True)
    dummies = [f"{c}_{v}" for c in COX_CAT for v in levels[c][1:]]
    hot = hot.withColumnsRenamed({d: f"dummy_{i}" for i, d in enumerate(dummies)})
    return SV.cox_fit(hot, "industry", [*COX_NUM, *[f"dummy_{i}" for i in range(len(dummies))]])


SURVIVAL = ", ".join(f"'{i}'" for i in catalog.SURVIVAL_INDUSTRIES)


@query("cox_hazard_ratios", ctes=("c360",), sql=f"""
SELECT industry, CAST(r.range AS INTEGER) AS rank, true AS positive, true AS converged FROM
  (SELECT DISTINCT industry FROM c360 WHERE industry IN ({SURVIVAL})), range(1, 6) r""")
def cox_hazard_ratios(spark, base):
    return SV.top_hazards(_hazards(spark, base), "industry").select(
        "industry", "rank", (F.col("hazard_ratio") > 0).alias("positive"), "converged")


@query("cox_score_check", ctes=("c360",), sql=f"""
SELECT DISTINCT industry, covariate, 0.0::DOUBLE AS score FROM c360, (VALUES {', '.join(f"('{c}')" for c in COX_NUM)}) AS v(covariate)
WHERE industry IN ({SURVIVAL})""")
def cox_score_check(spark, base):
    return _hazards(spark, base).where(F.col("covariate").isin(*COX_NUM)).select(
        "industry", "covariate", S.stable_round(F.col("score"), 3).alias("score"))


# --- ingestion and augmentation -----------------------------------------------
HASH = common.key_hash("customer_id")


@query("labelled_ingest", ctes=("c360",), sql=f"""
SELECT part, churned, count(*) AS n, {rnd('avg(tenure_months)', 4)} AS avg_tenure, {rnd('avg(signup_year)', 4)} AS avg_year FROM (
  SELECT churned, coalesce(tenure_months, 24) AS tenure_months, coalesce(signup_year, 2024) AS signup_year,
    CASE WHEN rn <= (n * 70 + 99) // 100 THEN 'train' WHEN rn <= (n * 85 + 99) // 100 THEN 'val' ELSE 'test' END AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY churned ORDER BY {HASH}, customer_id) AS rn, count(*) OVER (PARTITION BY churned) AS n FROM c360))
GROUP BY part, churned""")
def labelled_ingest(spark, base):
    df = C.feature_table(spark, base).select(
        "customer_id", F.col("region").alias("Region"), F.col("tenure_months").alias("Tenure"),
        F.concat_ws("-", F.col("signup_year").cast("string"), F.lit("03"), F.lit("04")).alias("Signup_Date"),
        F.col("orders_180d").alias("Orders"), F.col("cart_abandon_rate").alias("Cart_Abandonment"),
        F.when(F.col("churned") == 1, "Attrited Customer").otherwise("Existing Customer").alias("Attrition_Flag"))
    # A date without a year is just "03-04" and falls back to the default year.
    out = L.ingest(df, "ecommerce", "customer_id")
    return out.groupBy("part", "churned").agg(
        F.count(F.lit(1)).alias("n"), S.stable_round(F.avg("tenure_months"), 4).alias("avg_tenure"),
        S.stable_round(F.avg("signup_year"), 4).alias("avg_year"))


LAB = AQ.LABEL_AUGMENT


@query("augment_counts", ctes=("dirty",), sql=f"""
WITH v AS (SELECT {LAB} AS y FROM dirty WHERE {LAB} IS NOT NULL), t AS (SELECT y, (count(*) * 20 + 99) // 100 AS val, count(*) AS n FROM v GROUP BY y)
SELECT 'march_TRAIN.csv' AS file_name, 'Train Set' AS ingested_as, CAST(sum(n) AS BIGINT) AS train_records_added, CAST(0 AS BIGINT) AS val_records_added FROM t
UNION ALL SELECT 'calibration.csv', 'Validation Set', 0, CAST(sum(n) AS BIGINT) FROM t
UNION ALL SELECT 'march.csv', 'Split Train/Val (80/20)', CAST(sum(n - val) AS BIGINT), CAST(sum(val) AS BIGINT) FROM t""")
def augment_counts(spark, base):
    upload = U.untidy_customers(spark, base).select("id", F.col("label").alias("churned"))
    out = None
    for name in ("march_TRAIN.csv", "calibration.csv", "march.csv"):
        part = L.route_upload(upload, name, "id").agg(
            F.count(F.when(F.col("part") == "train", 1)).alias("train_records_added"),
            F.count(F.when(F.col("part") == "val", 1)).alias("val_records_added"),
        ).select(F.lit(name).alias("file_name"), S.route_by_filename(F.lit(name)).alias("ingested_as"),
                 "train_records_added", "val_records_added")
        out = part if out is None else out.unionByName(part)
    return out


# --- streaming -------------------------------------------------------------------
@query("stream_score_batch", ctes=("sets",), sql=f"""
SELECT customer_id, p, {TIER} AS action FROM sets WHERE level_pct = 85""")
def stream_score_batch(spark, base):
    landed = C.feature_table(spark, base)
    folder = landed.inputFiles()[0].rsplit("/", 1)[0]
    q = quantiles(spark, base)

    def score(df):
        sets = CF.prediction_sets(C.with_risk(df), q, ["industry"], level_pct=85)
        return sets.select("customer_id", "p", S.action_tier(F.col("in0"), F.col("in1")).alias("action"))

    stream = jobs.arriving(spark, folder, landed.schema)
    return jobs.score_arriving(stream, score, scratch_path(spark, "scored"), scratch_path(spark, "scored-checkpoint"))


@query("stream_augment_counts", ctes=("c360",), sql="SELECT industry, churned, count(*) AS n FROM c360 GROUP BY industry, churned")
def stream_augment_counts(spark, base):
    landed = C.feature_table(spark, base)
    folder = landed.inputFiles()[0].rsplit("/", 1)[0]
    out = scratch_path(spark, "augmented")
    stream = jobs.arriving(spark, folder, landed.schema)
    jobs.append_arriving(stream, lambda b: b.select("customer_id", "industry", "churned"), out,
                         scratch_path(spark, "augmented-checkpoint"))
    appended = jobs.arriving(spark, out, landed.select("customer_id", "industry", "churned").schema)
    return jobs.running_counts(appended, ["industry", "churned"])


# --- dashboard ---------------------------------------------------------------------
@query("industry_dashboard", ctes=("c360", "scored", "sets"), sql=f"""
SELECT industry, total_customers, churn_rate, avg_monthly, avg_tenure, retained_customers, churned_customers, accuracy_pct, auc_pct, brier_score,
  coverage_85, retained_85, churned_85, uncertain_85, net_benefit_85
FROM (SELECT industry, count(*) AS total_customers, {rnd('avg(churned) * 100', 2)} AS churn_rate, {rnd('avg(monthly_spend_usd)', 2)} AS avg_monthly,
  {rnd('avg(tenure_months)', 1)} AS avg_tenure, count(CASE WHEN churned = 0 THEN 1 END) AS retained_customers, count(CASE WHEN churned = 1 THEN 1 END) AS churned_customers
  FROM c360 GROUP BY industry)
LEFT JOIN (SELECT industry, {rnd('avg(CASE WHEN (p >= 0.5) = (churned = 1) THEN 1.0::DOUBLE ELSE 0 END) * 100', 2)} AS accuracy_pct,
  {rnd('avg(power(p - churned, 2))', 4)} AS brier_score FROM scored WHERE split = 'test' GROUP BY industry) USING (industry)
LEFT JOIN (SELECT industry, {rnd('roc_auc * 100', 2)} AS auc_pct FROM ({AUC})) USING (industry)
LEFT JOIN (SELECT industry, {rnd(f'{COVERAGE} * 100', 2)} AS coverage_85 FROM sets WHERE split = 'test' AND level_pct = 85 GROUP BY industry) USING (industry)
LEFT JOIN (SELECT industry, retained AS retained_85, churned AS churned_85, uncertain AS uncertain_85,
  churned * 200 + uncertain * 50 - (churned + uncertain) * 50 AS net_benefit_85 FROM ({DIST}) WHERE level_pct = 85) USING (industry)""")
def industry_dashboard(spark, base):
    df = C.feature_table(spark, base)
    kpis = P.industry_kpis(df)
    dist = P.target_distribution(df, ["industry"]).withColumnsRenamed(
        {"retained": "retained_customers", "churned": "churned_customers"})
    test = C.scored_customers(spark, base).where("split = 'test'")
    sets = CF.prediction_sets(test, quantiles(spark, base), ["industry"], level_pct=85)
    quality = M.accuracy(test, ["industry"]).select("industry", S.stable_round(F.col("accuracy") * 100, 2).alias("accuracy_pct")).join(
        M.roc_auc(test, ["industry"]).select("industry", S.stable_round(F.col("roc_auc") * 100, 2).alias("auc_pct")), "industry").join(
        M.brier(test, ["industry"]).select("industry", S.stable_round(F.col("brier_score"), 4).alias("brier_score")), "industry")
    cover = CF.coverage(sets, ["industry"]).select(
        "industry", S.stable_round(F.col("coverage") * 100, 2).alias("coverage_85"))
    impact = CF.business_impact(CF.set_distribution(sets, ["industry"])).select(
        "industry", F.col("retained").alias("retained_85"), F.col("churned").alias("churned_85"),
        F.col("uncertain").alias("uncertain_85"), F.col("net_benefit").alias("net_benefit_85"))
    return kpis.join(dist, "industry").join(quality, "industry", "left").join(cover, "industry", "left").join(
        impact, "industry", "left")




def dashboard_state(spark, base) -> str:
    """The state of the customers after three batches, one of them sent twice."""
    path = scratch_path(spark, "dashboard")
    rows, scored = C.feature_table(spark, base), C.scored_customers(spark, base)
    for batch in (0, 1, 2, 1):
        mine = F.col("customer_id") % 3 == batch
        DB.append(path, f"b{batch}", rows.where(mine), scored.where(mine))
    return path


_SETS_OF = "FROM sets WHERE split = '{}' GROUP BY industry, level_pct"


@query("dashboard_incremental", ctes=("c360", "scored", "sets"), sql=f"""
SELECT industry, total_customers, churn_rate, avg_monthly, avg_tenure, retained_customers, churned_customers, accuracy_pct, auc_pct, brier_score,
  calibration_score, level_pct, coverage, avg_set_size, retained, churned, uncertain, (churned + uncertain) * 50 AS outreach_cost,
  churned * 200 + uncertain * 50 AS saved_value, churned * 200 + uncertain * 50 - (churned + uncertain) * 50 AS net_benefit, confident_rate_train, confident_rate_val
FROM (SELECT industry, count(*) AS total_customers, {rnd('avg(churned) * 100', 2)} AS churn_rate, {rnd('avg(monthly_spend_usd)', 2)} AS avg_monthly,
  {rnd('avg(tenure_months)', 1)} AS avg_tenure, count(CASE WHEN churned = 0 THEN 1 END) AS retained_customers, count(CASE WHEN churned = 1 THEN 1 END) AS churned_customers
  FROM c360 GROUP BY industry)
LEFT JOIN (SELECT industry, {rnd('avg(CASE WHEN (p >= 0.5) = (churned = 1) THEN 1.0::DOUBLE ELSE 0 END) * 100', 2)} AS accuracy_pct,
  {rnd('avg(power(p - churned, 2))', 4)} AS brier_score, {rnd('(1 - avg(power(p - churned, 2))) * 100', 1)} AS calibration_score
  FROM scored WHERE split = 'test' GROUP BY industry) USING (industry)
LEFT JOIN (SELECT industry, {rnd('roc_auc * 100', 2)} AS auc_pct FROM ({AUC})) USING (industry)
LEFT JOIN (SELECT industry, level_pct, {rnd(f'{COVERAGE} * 100', 2)} AS coverage, {rnd('avg(in0::INTEGER + in1::INTEGER)', 4)} AS avg_set_size {_SETS_OF.format('test')}) USING (industry)
LEFT JOIN ({DIST}) USING (industry, level_pct)
LEFT JOIN (SELECT industry, level_pct, {rnd('avg(CASE WHEN in0 <> in1 THEN 1.0::DOUBLE ELSE 0 END) * 100', 2)} AS confident_rate_train {_SETS_OF.format('train')}) USING (industry, level_pct)
LEFT JOIN (SELECT industry, level_pct, {rnd('avg(CASE WHEN in0 <> in1 THEN 1.0::DOUBLE ELSE 0 END) * 100', 2)} AS confident_rate_val {_SETS_OF.format('val')}) USING (industry, level_pct)""")
def dashboard_incremental(spark, base):
    """All numbers of the dashboard from the states that three batches added up to, a row for each level."""
    out = DB.assemble(*DB.state(spark, dashboard_state(spark, base)))
    return out.select("*", F.inline_outer("levels")).drop("levels")


@query("dashboard_full")
def dashboard_full(spark, base):
    """One row per industry: with the model's importances, its learners' accuracies and the files besides."""
    df, model = C.feature_table(spark, base), stacked(spark, base)
    industries = df.select("industry").distinct()
    importances = industries.join(MD.importance_table(spark, model))
    test = _stack_scores(spark, base).where("split = 'test'").join(df.select("customer_id", "industry"), "customer_id")
    learners = M.accuracy(test, ["industry", "model"]).select(
        "industry", F.col("model").alias("learner"), S.stable_round(F.col("accuracy") * 100, 2).alias("accuracy_pct"))
    path = scratch_path(spark, "splits")
    TB.write_splits(df, path)
    kinds = {"train": "Train Set (RAG Reference)", "val": "Validation Set (UQ Calibration)", "test": "Test Set (Out-of-sample)"}
    files = None
    for split, kind in kinds.items():
        own = TB.file_catalog(spark, path, kind).where(F.col("path").contains(f"/split={split}/")).withColumn(
            "industry", F.regexp_extract("path", "/industry=([^/]+)/", 1)).select("industry", "name", "kind", "rows", "size_kb")
        files = own if files is None else files.unionByName(own)
    return DB.assemble(*DB.state(spark, dashboard_state(spark, base)), importances, learners, files)
