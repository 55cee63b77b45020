"""Retrieval, drift, what-if and the flagship batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars as S
from tidemark.operators import align as A
from tidemark.operators import conformal as CF
from tidemark.operators import knn as K
from tidemark.operators import scoring as SC
from tidemark.operators.bridge import FeatureBridge
from tidemark.operators.serving import EVIDENCE, evidence_payload, score_upload
from tidemark.plans import common
from tidemark.plans.learning_queries import SCALED, scaled_customers
from tidemark.plans.quality_queries import P0, TIER, quantiles
from tidemark.plans.registry import define_cte, query, rnd
from tidemark.session import scratch_path
from tidemark.sources import customers as C
from tidemark.sources import tables as TB


def neighbour_sql(source: str, features, group: str = "industry", asked: str = "q.split = 'test'") -> str:
    square = " + ".join(f"(q.{c} - r.{c}) * (q.{c} - r.{c})" for c in features)
    return f"""SELECT grp, qid, rid, dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM (
    SELECT q.{group} AS grp, q.customer_id AS qid, r.customer_id AS rid, {rnd(f'sqrt({square})', 6)} AS dist
    FROM {source} q JOIN {source} r ON q.{group} = r.{group} WHERE {asked} AND r.split = 'train')) WHERE rank <= 5"""


define_cte("nb", neighbour_sql("scaled", SCALED), "scaled")


def neighbours(spark, base):
    """Test customers against the training customers of their industry."""
    df = scaled_customers(spark, base)
    q = K.vectors(df.where(F.col("split") == "test"), "customer_id", SCALED, "industry", "qid")
    r = K.vectors(df.where(F.col("split") == "train"), "customer_id", SCALED, "industry", "rid")
    return K.knn_join(q, r)


@query("knn_join", ctes=("nb",), sql="SELECT * FROM nb")
def knn_join(spark, base):
    return neighbours(spark, base)


@query("knn_join_tiled", sql=f"""
SELECT '' AS grp, qid, rid, dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM (
  SELECT q.vec_id AS qid, r.vec_id AS rid, {rnd('list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[])', 6)} AS dist
  FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id)) WHERE rank <= 5""")
def knn_join_tiled(spark, base):
    df = TB.table(spark, base, "embeddings").select(
        F.lit("").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    # The limit is set low so that the large-reference path runs whatever the data size.
    return K.knn_join(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "rid"),
                      exclude_self=True, broadcast_values=1_000, tile_rows=4_096)


@query("knn_join_lsh", ctes=("scaled",), sql="""
SELECT industry AS grp, count(CASE WHEN split = 'test' THEN 1 END) AS queries, true AS recall_reached
FROM scaled GROUP BY industry""")
def knn_join_lsh(spark, base):
    """The hashed join against the exact one: whether an industry's recall reaches 0.9."""
    df = scaled_customers(spark, base)
    q = K.vectors(df.where(F.col("split") == "test"), "customer_id", SCALED, "industry", "qid")
    r = K.vectors(df.where(F.col("split") == "train"), "customer_id", SCALED, "industry", "rid")
    return K.lsh_recall(q, r).select("grp", "queries", (F.col("recall") >= 0.9).alias("recall_reached"))


SIM = "100.0::DOUBLE / (1.0::DOUBLE + dist)"
define_cte("votes", f"""
SELECT grp AS industry, qid AS customer_id, avg(churned) AS p_retrieval, avg(CASE WHEN rank <= 3 THEN {SIM} END) AS avg_similarity
FROM nb JOIN (SELECT customer_id AS rid, churned FROM c360) USING (rid) GROUP BY grp, qid""", "nb", "c360")


def votes(spark, base):
    payload = C.feature_table(spark, base).select(F.col("customer_id").alias("rid"), "churned")
    return K.summarise(neighbours(spark, base), payload, []).select(
        F.col("grp").alias("industry"), F.col("qid").alias("customer_id"), "p_retrieval", "avg_similarity")


@query("neighbour_vote", ctes=("votes",), sql=f"""
SELECT industry, customer_id, {rnd('p_retrieval', 6)} AS p_retrieval, {rnd('avg_similarity', 4)} AS avg_similarity FROM votes""")
def neighbour_vote(spark, base):
    return votes(spark, base).withColumns({
        "p_retrieval": S.stable_round(F.col("p_retrieval"), 6), "avg_similarity": S.stable_round(F.col("avg_similarity"), 4)})


@query("ood_rows", ctes=("votes",), sql="SELECT customer_id, avg_similarity < 35.0 AS ood FROM votes")
def ood_rows(spark, base):
    return votes(spark, base).select("customer_id", K.out_of_distribution(F.col("avg_similarity")).alias("ood"))


@query("drift_status", ctes=("votes",), sql=f"""
SELECT industry, n, ood_rows, ood_pct, CASE WHEN ood_pct > 30 THEN 'Drift Warning' WHEN ood_pct > 15 THEN 'Caution' ELSE 'Safe' END AS status
FROM (SELECT industry, count(*) AS n, count(CASE WHEN avg_similarity < 35.0 THEN 1 END) AS ood_rows,
  {rnd('count(CASE WHEN avg_similarity < 35.0 THEN 1 END) * 100 / count(*)', 1)} AS ood_pct FROM votes GROUP BY industry)""")
def drift_status(spark, base):
    return K.drift_audit(votes(spark, base), ["industry"]).withColumn("status", S.drift_status(F.col("ood_pct")))


DETAIL = """CASE industry WHEN 'saas' THEN 'Seats: 5 | Feature score: ' || CAST(feature_adoption_score AS VARCHAR)
  WHEN 'telecom' THEN 'Plan: prepaid | Data: 10.0 GB' WHEN 'retail' THEN 'Tier: ' || loyalty_tier || ' | Basket: $50.0'
  WHEN 'banking' THEN 'Account: checking | Balance: $' || CAST(avg_balance_usd AS VARCHAR)
  WHEN 'ecommerce' THEN 'Orders: ' || CAST(coalesce(orders_180d, 5) AS VARCHAR) || ' | Cart Abandon: ' || CAST(cart_abandon_rate AS VARCHAR)
  WHEN 'education' THEN 'Courses: 2 | Completion: ' || CAST(completion_rate AS VARCHAR) WHEN 'healthcare' THEN 'Plan: standard | Appts: 3'
  WHEN 'hospitality' THEN 'Level: ' || membership_level || ' | Stays: 2' WHEN 'insurance' THEN 'Policy: auto | Policies: 1'
  ELSE 'Service: electricity | Smart Meter: ' || CAST(smart_meter_enabled AS VARCHAR) END"""
SEGMENT = "upper(substr(customer_segment, 1, 1)) || lower(substr(customer_segment, 2)) || ' segment'"


@query("knn_evidence", ctes=("nb", "c360"), sql=f"""
SELECT qid, rank, {rnd(SIM, 1)} AS similarity, {SEGMENT} AS segment, coalesce(tenure_months, 24) AS tenure, contract_type AS contract,
  {rnd('coalesce(monthly_spend_usd, 100)', 2)} AS monthly_charges, {DETAIL} AS detail, CASE WHEN churned = 1 THEN 'Yes' ELSE 'No' END AS churned
FROM nb JOIN c360 ON rid = customer_id WHERE rank <= 3""")
def knn_evidence(spark, base):
    payload = evidence_payload(C.feature_table(spark, base))
    out = K.summarise(neighbours(spark, base), payload, [F.col(c) for c in EVIDENCE])
    rows = out.select("qid", F.inline("sources"))
    return rows.select("qid", "rank", "similarity", "segment", "tenure", "contract",
                       S.stable_round(F.col("monthly_charges"), 2).alias("monthly_charges"), "detail",
                       F.col("churned_text").alias("churned"))


@query("blend_retrieval", ctes=("votes", "scored"), sql=f"""
SELECT customer_id, {rnd('0.8::DOUBLE * p + 0.2::DOUBLE * p_retrieval', 6)} AS p_final FROM scored JOIN votes USING (customer_id)""")
def blend_retrieval(spark, base):
    rows = C.scored_customers(spark, base).where(F.col("split") == "test").join(
        votes(spark, base).select("customer_id", "p_retrieval"), "customer_id")
    p = S.blend_retrieval(F.col("p"), F.col("p_retrieval"))
    return rows.select("customer_id", S.stable_round(p, 6).alias("p_final"))


@query("blend_proxy", ctes=("scored",), sql=f"""
SELECT customer_id, {rnd('least(greatest(a * p + (1 - a) * proxy, 0), 1)', 6)} AS p_blend FROM (
  SELECT customer_id, p, (customer_id * 29 % 101)::DOUBLE / 100 AS proxy, least(greatest((customer_id % 22)::DOUBLE / 21, 0.3), 0.9) AS a FROM scored)""")
def blend_proxy(spark, base):
    proxy = (F.col("customer_id") * 29 % 101).cast("double") / 100
    overlap = (F.col("customer_id") % 22).cast("double") / 21
    return C.scored_customers(spark, base).select(
        "customer_id", S.stable_round(S.blend_proxy(F.col("p"), proxy, overlap), 6).alias("p_blend"))


OPTIMA = {
    "contract_type": "CASE WHEN industry = 'telecom' THEN 'annual' ELSE contract_type END",
    "feature_adoption_score": "CASE WHEN industry = 'saas' THEN 0.9::DOUBLE ELSE feature_adoption_score END",
    "loyalty_tier": "CASE WHEN industry = 'retail' THEN 'gold' ELSE loyalty_tier END",
    "avg_balance_usd": "CASE WHEN industry = 'banking' THEN coalesce(avg_balance_usd, 0) + 5000.0::DOUBLE ELSE avg_balance_usd END",
    "cart_abandon_rate": "CASE WHEN industry = 'ecommerce' THEN 0.1::DOUBLE ELSE cart_abandon_rate END",
    "completion_rate": "CASE WHEN industry = 'education' THEN 0.9::DOUBLE ELSE completion_rate END",
    "missed_appointments_12m": "CASE WHEN industry = 'healthcare' THEN 0 ELSE missed_appointments_12m END",
    "membership_level": "CASE WHEN industry = 'hospitality' THEN 'gold' ELSE membership_level END",
    "agent_contact_90d": "CASE WHEN industry = 'insurance' THEN 1 ELSE agent_contact_90d END",
    "smart_meter_enabled": "CASE WHEN industry = 'utilities' THEN 1 ELSE smart_meter_enabled END",
}


@query("what_if", ctes=("full_scored", "quant"), sql=f"""
SELECT customer_id, p, p_opt, {rnd('greatest(p - p_opt, 0)', 6)} AS impact, {TIER} AS action,
  {TIER.replace('in0', 'o0').replace('in1', 'o1')} AS opt_action FROM (
  SELECT *, {P0} >= cut AS in0, p >= cut AS in1, {rnd('1 - p_opt', 6)} >= cut AS o0, p_opt >= cut AS o1 FROM (
    SELECT customer_id, industry, p, {common.risk_sql(**{k: f'({v})' for k, v in OPTIMA.items()})} AS p_opt FROM full_scored)
  JOIN (SELECT industry, {rnd('1 - qhat', 6)} AS cut FROM quant WHERE level_pct = 85) USING (industry))""")
def what_if(spark, base):
    df = C.with_risk(C.feature_table(spark, base))
    risky = SC.intervene(df)
    p_opt = C.risk_score(F.col("industry"), {c: F.col(c) for c in C.SCORE_INPUTS})
    rows = risky.withColumn("p_opt", p_opt)
    q = quantiles(spark, base).where(F.col("level_pct") == 85).select("industry", "qhat")
    in0, in1 = CF.in_set(F.col("p"), F.col("qhat"))
    o0, o1 = CF.in_set(F.col("p_opt"), F.col("qhat"))
    gain = F.greatest(F.col("p") - F.col("p_opt"), F.lit(0.0))
    return rows.join(F.broadcast(q), "industry").select(
        "customer_id", "p", "p_opt", S.stable_round(gain, 6).alias("impact"),
        S.action_tier(in0, in1).alias("action"), S.action_tier(o0, o1).alias("opt_action"))


def _driver_sql() -> str:
    return """array_to_string(CASE WHEN len(d) > 0 THEN d ELSE ['Mostly low-risk features selected.'] END, ' / ')"""


@query("risk_drivers", ctes=("c360",), sql=f"""
SELECT customer_id, {_driver_sql()} AS drivers FROM (SELECT customer_id, list_filter([
  CASE WHEN contract_type = 'month_to_month' THEN 'Short-term Contract (Month-to-month) increases risk of early churn.' END,
  CASE WHEN support_tickets_90d > 5 THEN 'High support ticket volume (' || support_tickets_90d || ' in last 90 days) indicates technical frustration.' END,
  CASE WHEN nps_score < 7 THEN 'Low Customer NPS score (' || nps_score || ') indicates dissatisfaction or negative sentiment.' END,
  CASE WHEN industry = 'telecom' AND dropped_calls_30d > 5 THEN 'High dropped call frequency (' || dropped_calls_30d || ' in 30 days) signals signal/coverage issues.' END,
  CASE WHEN industry = 'saas' AND feature_adoption_score < 0.5 THEN 'Low feature adoption (' || CAST(floor(feature_adoption_score * 100 + 0.5::DOUBLE) AS INTEGER) || '%) shows low product utilization.' END,
  CASE WHEN industry = 'retail' AND days_since_last_activity > 45 THEN 'High inactivity period (' || days_since_last_activity || ' days) suggests customer is slipping away.' END,
  CASE WHEN industry = 'banking' AND overdrafts_12m > 1 THEN 'Customer has ' || overdrafts_12m || ' overdrafts in last 12 months, indicating financial stress.' END],
  lambda x: x IS NOT NULL) AS d FROM c360)""")
def risk_drivers(spark, base):
    df = C.feature_table(spark, base)
    drivers = S.risk_drivers(F.col("industry"), {c: F.col(c) for c in df.columns})
    return df.select("customer_id", F.array_join(drivers, " / ").alias("drivers"))


# ---------------------------------------------------------------------------
# Flagship: score an uploaded table end to end
# ---------------------------------------------------------------------------
UPLOAD = {
    "Customer_ID": "customer_id", "Signup_Year": "signup_year", "Region": "region", "Segment": "customer_segment",
    "Tenure": "tenure_months", "Contract": "contract_type", "MonthlyCharges": "monthly_spend_usd", "Discount": "discount_pct",
    "Tickets": "support_tickets_90d", "NPS": "nps_score", "Recency": "days_since_last_activity", "Orders": "orders_180d",
    "Cart_Abandonment": "cart_abandon_rate", "Average_Order_Value": "avg_order_value_usd", "Refund_Rate": "return_rate",
    "Sessions": "app_sessions_30d",
}
MAPPED = [f for f in UPLOAD.values() if f != "customer_id"]
EC_KNN = ["tenure_months", "monthly_spend_usd", "discount_pct", "return_rate", "days_since_last_activity",
          "orders_180d", "avg_order_value_usd"]


def ecommerce_risk(df, name: str):
    """The fixed-coefficient risk for rows that all belong to one industry."""
    have = set(df.columns)
    cols = {c: F.col(c) if c in have else F.lit(catalog.DEFAULTS[c]) for c in C.SCORE_INPUTS}
    return df.withColumn(name, C.risk_score(F.lit("ecommerce"), cols))


def uploaded_batch(spark, base):
    return C.feature_table(spark, base).select(*[F.col(f).alias(h) for h, f in UPLOAD.items()])


def reference_rows(spark, base, split: str):
    df = C.feature_table(spark, base).where(F.col("split") == split)
    return A.clean_features(df, "ecommerce", ["customer_id", "churned"])


def scored_upload(spark, base):
    return score_upload(uploaded_batch(spark, base), reference_rows(spark, base, "train"),
                        reference_rows(spark, base, "val"), ecommerce_risk, EC_KNN)


def shown(report):
    """A decision report with its evidence as text."""
    text = F.transform("sources", lambda s: F.concat(
        s["similarity"].cast("string"), F.lit(" "), s["segment"], F.lit(" "), s["churned_text"]))
    return report.withColumn("sources", F.array_join(text, " / "))


def decisions_of(scored):
    return shown(SC.decisions(scored, [F.col(f).alias(h) for h, f in UPLOAD.items()]))


def decision_rows(spark, base):
    return decisions_of(scored_upload(spark, base)[1])


def _clean_sql(f: str) -> str:
    return f"coalesce({f}, {catalog.DEFAULTS[f]!r}) AS {f}"


EC_CONST = {f: repr(catalog.DEFAULTS[f]) for f in C.SCORE_INPUTS if f not in catalog.SCHEMAS["ecommerce"]}
_EC_RISK = common.risk_sql(**EC_CONST)
_EC_OPT = common.risk_sql(**{**EC_CONST, "cart_abandon_rate": "0.1::DOUBLE"})
define_cte("ec", f"""SELECT *, {_EC_RISK} AS p, {_EC_OPT} AS p_opt FROM (
  SELECT customer_id, split, churned, 'ecommerce' AS industry, {', '.join(_clean_sql(f) for f in MAPPED)} FROM c360)""", "c360")
define_cte("ec_m", "SELECT " + ", ".join(
    f"avg({c}::DOUBLE) AS mu_{c}, CASE WHEN stddev_pop({c}::DOUBLE) = 0 THEN 1 ELSE stddev_pop({c}::DOUBLE) END AS sd_{c}" for c in EC_KNN
) + " FROM ec WHERE split = 'train'", "ec")
define_cte("ec_s", "SELECT customer_id, split, industry, " + ", ".join(
    f"({c}::DOUBLE - mu_{c}) / sd_{c} AS {c}" for c in EC_KNN) + " FROM ec, ec_m", "ec", "ec_m")
define_cte("ec_nb", neighbour_sql("ec_s", EC_KNN, asked="true"), "ec_s")
define_cte("ec_v", f"""
SELECT qid AS customer_id, avg(churned) AS vote, avg(CASE WHEN rank <= 3 THEN {SIM} END) AS avg_similarity,
  string_agg(CASE WHEN rank <= 3 THEN CAST({rnd(SIM, 1)} AS VARCHAR) || ' ' || {SEGMENT} || ' ' || CASE WHEN churned = 1 THEN 'Yes' ELSE 'No' END END, ' / ' ORDER BY rank) AS sources
FROM ec_nb JOIN (SELECT customer_id AS rid, churned, customer_segment FROM ec) USING (rid) GROUP BY qid""", "ec_nb", "ec")
S_SCORE = rnd(f"1 - CASE WHEN churned = 1 THEN p ELSE {P0} END", 6)
define_cte("ec_q", f"""
SELECT {rnd('1 - coalesce(max(CASE WHEN rn = ((n + 1) * 85 + 99) // 100 THEN s END), 1)', 6)} AS cut
FROM (SELECT {S_SCORE} AS s, row_number() OVER (ORDER BY {S_SCORE}) AS rn, count(*) OVER () AS n FROM ec WHERE split = 'val')""", "ec")
define_cte("ec_out", f"""
SELECT *, 0.8::DOUBLE * p + 0.2::DOUBLE * vote AS p_final, 0.8::DOUBLE * p_opt + 0.2::DOUBLE * vote AS p_opt_final,
  {P0} >= cut AS in0, p >= cut AS in1, {rnd('1 - p_opt', 6)} >= cut AS o0, p_opt >= cut AS o1
FROM ec JOIN ec_v USING (customer_id), ec_q""", "ec", "ec_v", "ec_q")
SET_TEXT = "CASE WHEN in1 AND NOT in0 THEN 'Churned' WHEN in0 AND NOT in1 THEN 'Retained' ELSE 'Retained, Churned' END"


def _opt(x: str) -> str:
    return x.replace("in0", "o0").replace("in1", "o1")


DECISIONS = "SELECT " + ", ".join(f"{f} AS \"{h}\"" for h, f in UPLOAD.items()) + f""",
  {rnd('p_final * 100', 2)} AS churn_probability_pct, {SET_TEXT} AS conformal_prediction_set, {TIER} AS recommended_business_action, sources,
  {rnd('p_opt_final * 100', 2)} AS opt_churn_probability_pct, {_opt(SET_TEXT)} AS opt_conformal_prediction_set, {_opt(TIER)} AS opt_recommended_business_action
FROM ec_out"""


@query("score_batch", ctes=("ec_out",), sql=DECISIONS)
def score_batch(spark, base):
    return decision_rows(spark, base)


@query("decision_report", ctes=("ec_out",), sql=DECISIONS)
def decision_report(spark, base):
    rows = decision_rows(spark, base)
    path = scratch_path(spark, "decisions")
    TB.export_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("batch_summary", ctes=("ec_out",), sql=f"""
SELECT *, {rnd('greatest(0, avg_churn_risk - avg_optimized_risk)', 1)} AS risk_reduction FROM (
  SELECT count(*) AS total_records, count(CASE WHEN {TIER} <> 'No Intervention' THEN 1 END) AS standout_records,
    {rnd('avg(CASE WHEN in0 <> in1 THEN 1.0::DOUBLE ELSE 0 END) * 100', 1)} AS batch_confident_rate,
    {rnd('avg(p_final) * 100', 1)} AS avg_churn_risk, {rnd('avg(p_opt_final) * 100', 1)} AS avg_optimized_risk FROM ec_out)""")
def batch_summary(spark, base):
    return SC.batch_summary(scored_upload(spark, base)[1])


@query("bridge_report", ctes=("c360",), sql="""
SELECT 'ecommerce' AS detected_industry, 71.4::DOUBLE AS schema_overlap_pct, 15 AS mapped_features_count, 6 AS imputed_features_count,
  6 AS static_default, count(*) AS "rows" FROM c360""")
def bridge_report(spark, base):
    bridge = FeatureBridge().transform(uploaded_batch(spark, base))
    rows = bridge.df.agg(F.count(F.lit(1)).alias("rows")).withColumn("k", F.lit(1))
    report = bridge.report.select(
        "detected_industry", "schema_overlap_pct", "mapped_features_count", "imputed_features_count",
        F.col("imputation_breakdown.static_default").alias("static_default"), F.lit(1).alias("k"))
    return report.join(rows, "k").drop("k")


_FILLED = ["monthly_spend_usd", "orders_180d", "return_rate"]


@query("bridge_imputed", ctes=("c360",), sql=f"""
SELECT customer_id, region, tenure_months, {', '.join(f'md_{c} AS {c}' for c in _FILLED)}, contract_type, 40 AS age
FROM (SELECT customer_id, region, tenure_months FROM c360),
  (SELECT {', '.join(f'median({c})::DOUBLE AS md_{c}' for c in _FILLED)} FROM c360 WHERE split = 'train'),
  (SELECT contract_type FROM c360 WHERE split = 'train' GROUP BY contract_type ORDER BY count(*) DESC, contract_type LIMIT 1)""")
def bridge_imputed(spark, base):
    # One numeric predictor is too few for a regression: medians and modes of the training rows fill in.
    df = C.feature_table(spark, base)
    upload = df.select(
        F.col("customer_id").alias("Customer_ID"), F.col("region").alias("Region"), F.col("tenure_months").alias("Tenure"))
    training = df.where(F.col("split") == "train").select(*MAPPED)
    out = FeatureBridge("ecommerce", training).transform(upload)
    return out.df.select("customer_id", "region", "tenure_months", *_FILLED, "contract_type", "age")


_X1, _X2, _Y = "tenure_months", "monthly_spend_usd", "orders_180d"


@query("bridge_correlated", ctes=("c360",), sql=f"""
WITH t AS (SELECT * FROM c360 WHERE split = 'train'),
m AS (SELECT median({_X1})::DOUBLE AS m1, median({_X2})::DOUBLE AS m2, median({_Y})::DOUBLE AS my FROM t),
z AS (SELECT coalesce({_X1}, m1) - m1 AS a, coalesce({_X2}, m2) - m2 AS b, coalesce({_Y}, my) - my AS y FROM t, m),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS mean_y, sum(a * a) - sum(a) * sum(a) / count(*) + 1 AS saa, sum(b * b) - sum(b) * sum(b) / count(*) + 1 AS sbb,
  sum(a * b) - sum(a) * sum(b) / count(*) AS sab, sum(a * y) - sum(a) * sum(y) / count(*) AS say, sum(b * y) - sum(b) * sum(y) / count(*) AS sby FROM z),
w AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM s)
SELECT customer_id, CAST(round_even(greatest(my + mean_y + wa * (coalesce({_X1}, m1) - m1 - ma) + wb * (coalesce({_X2}, m2) - m2 - mb), 0), 0) AS INTEGER) AS {_Y},
  'correlation' AS source FROM c360, m, w""")
def bridge_correlated(spark, base):
    """A feature that the upload lacks, predicted by ridge regression from the two it has."""
    df = C.feature_table(spark, base)
    training = df.where(F.col("split") == "train").select(_X1, _X2, _Y)
    upload = df.select(F.col("customer_id").alias("Customer_ID"), F.col(_X1).alias("Tenure"), F.col(_X2).alias("MonthlyCharges"))
    out = FeatureBridge("ecommerce", training).transform(upload)
    return out.df.select("customer_id", _Y, F.lit(out.sources[_Y]).alias("source"))
