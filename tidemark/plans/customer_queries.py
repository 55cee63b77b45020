"""Customer-level aggregates: KPIs, distributions, profiles, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import stable_round
from tidemark.operators import profile as P
from tidemark.operators import selection as SEL
from tidemark.operators import splitting as SP
from tidemark.plans import common  # noqa: F401
from tidemark.plans.registry import query, rnd
from tidemark.sources import customers as C
from tidemark.sources.tables import table

NUMERIC = ["tenure_months", "monthly_spend_usd", "discount_pct", "return_rate",
           "days_since_last_activity", "orders_180d", "avg_order_value_usd",
           "support_tickets_90d", "avg_balance_usd"]
TEXTS = ["region", "customer_segment", "contract_type", "loyalty_tier"]
ALL_NUMERIC = [*NUMERIC, "app_sessions_30d", "nps_score", "feature_adoption_score", "cart_abandon_rate", "completion_rate",
               "missed_appointments_12m", "agent_contact_90d", "smart_meter_enabled", "overdrafts_12m", "dropped_calls_30d"]
ALL_TEXTS = [*TEXTS, "membership_level"]


@query("customer_360", ctes=("c360",), sql="SELECT * FROM c360")
def customer_360(spark, base):
    return C.customer_360(spark, base)


@query("industry_kpis", ctes=("c360",), sql=f"""
SELECT industry, count(*) AS total_customers, {rnd('avg(churned) * 100', 2)} AS churn_rate,
  {rnd('avg(monthly_spend_usd)', 2)} AS avg_monthly, {rnd('avg(tenure_months)', 1)} AS avg_tenure
FROM c360 GROUP BY industry""")
def industry_kpis(spark, base):
    return P.industry_kpis(C.customer_360(spark, base))


@query("churn_distribution", ctes=("c360",), sql="""
SELECT industry, count(CASE WHEN churned = 0 THEN 1 END) AS retained, count(CASE WHEN churned = 1 THEN 1 END) AS churned
FROM c360 GROUP BY industry""")
def churn_distribution(spark, base):
    return P.target_distribution(C.feature_table(spark, base), ["industry"])


@query("value_counts_pct", sql=f"""
SELECT o_orderstatus AS value, count(*) AS n, {rnd('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders)', 2)} AS pct
FROM orders GROUP BY 1""")
def value_counts_pct(spark, base):
    return P.value_counts(table(spark, base, "orders"), "o_orderstatus")


_LI_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
             "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
             "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("profile_columns", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS \"rows\", count({c}) AS non_null FROM lineitem"
    for c, t in _LI_TYPES.items()))
def profile_columns(spark, base):
    return P.profile_columns(table(spark, base, "lineitem"))


_NB = ["customer_id", "industry", "split", *ALL_TEXTS, "signup_year", *ALL_NUMERIC, "churned", "note"]


@query("null_blank_counts", ctes=("c360",), sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(CASE WHEN {c} IS NULL THEN 1 END) AS nulls, "
    f"count(CASE WHEN trim(CAST({c} AS VARCHAR)) = '' THEN 1 END) AS blanks FROM n" for c in _NB
).join(["SELECT * FROM (WITH n AS (SELECT *, CASE WHEN customer_id % 7 = 0 THEN '  ' ELSE customer_segment END AS note FROM c360) ", ")"]))
def null_blank_counts(spark, base):
    df = C.feature_table(spark, base)
    note = F.when(F.col("customer_id") % 7 == 0, F.lit("  ")).otherwise(F.col("customer_segment"))
    return P.null_blank_counts(df.withColumn("note", note).select(*_NB))


_CORR = ALL_NUMERIC


@query("correlation_matrix", ctes=("c360",), sql=" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'corr({a}::DOUBLE, {b}::DOUBLE)', 6)} AS r FROM c360"
    for i, a in enumerate(_CORR) for b in _CORR[i:]))
def correlation_matrix(spark, base):
    out = P.correlation_matrix(C.feature_table(spark, base), _CORR)
    return out.withColumn("r", stable_round(F.col("r"), 6))


@query("category_churn_counts", ctes=("c360",), sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {c} AS category, count(CASE WHEN churned = 0 THEN 1 END) AS retained,
  count(CASE WHEN churned = 1 THEN 1 END) AS churned, {rnd('avg(churned) * 100', 2)} AS churn_rate FROM c360 GROUP BY {c}"""
    for c in ALL_TEXTS))
def category_churn_counts(spark, base):
    long = C.feature_table(spark, base).unpivot(["churned"], ALL_TEXTS, "feature", "category")
    return P.category_label_counts(long, "category", by=["feature"])


@query("class_histogram", ctes=("c360",), sql=f"""
SELECT churned, bin, n, {rnd('n / sum(n) OVER (PARTITION BY churned)', 6)} AS share FROM (
  SELECT churned, CAST(least(greatest(floor((monthly_spend_usd - 0) / 2500.0::DOUBLE) + 1, 0), 21) AS BIGINT) AS bin, count(*) AS n
  FROM c360 WHERE monthly_spend_usd IS NOT NULL GROUP BY 1, 2)""")
def class_histogram(spark, base):
    return P.class_histogram(C.feature_table(spark, base), "monthly_spend_usd", 0.0, 50000.0, 20)


_GRID = [float(g) for g in range(0, 80, 4)]


@query("class_kde", ctes=("c360",), sql=f"""
SELECT churned, x, {rnd('sum(c * exp(-0.5::DOUBLE * power((x - center) / h, 2)) / (n * h * 2.5066282746310002::DOUBLE))', 8)} AS density
FROM (SELECT churned, tenure_months::DOUBLE AS center, count(*) AS c FROM c360 WHERE tenure_months IS NOT NULL GROUP BY 1, 2)
JOIN (SELECT churned, count(tenure_months) AS n, stddev_samp(tenure_months) * power(count(tenure_months)::DOUBLE, -0.2::DOUBLE) AS h
      FROM c360 GROUP BY 1) USING (churned), (SELECT unnest({_GRID})::DOUBLE AS x)
GROUP BY churned, x""")
def class_kde(spark, base):
    return P.class_density(C.feature_table(spark, base), "tenure_months", _GRID, 1.0)


@query("feature_medians", ctes=("c360",), sql=" UNION ALL ".join(
    f"SELECT industry, '{c}' AS \"column\", count({c}) AS n, {rnd(f'coalesce(median({c}), 0)', 4)} AS median FROM c360 GROUP BY industry HAVING count({c}) > 0"
    for c in NUMERIC))
def feature_medians(spark, base):
    out = SEL.medians(C.feature_table(spark, base), NUMERIC, ["industry"])
    return out.withColumn("median", stable_round(F.col("median"), 4))


@query("feature_modes", ctes=("c360",), sql=" UNION ALL ".join(
    f"""SELECT industry, '{c}' AS "column", n, mode FROM (SELECT industry, {c} AS mode, CAST(sum(count(*)) OVER (PARTITION BY industry) AS BIGINT) AS n,
  row_number() OVER (PARTITION BY industry ORDER BY count(*) DESC, {c}) AS rk FROM c360 WHERE {c} IS NOT NULL GROUP BY industry, {c}) WHERE rk = 1"""
    for c in TEXTS))
def feature_modes(spark, base):
    return SEL.modes(C.feature_table(spark, base), TEXTS, ["industry"])


@query("zero_variance_columns", ctes=("c360",), sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", var_samp({e}) = 0 AS zero_variance FROM c360"
    for c, e in [*zip(ALL_NUMERIC, ALL_NUMERIC), ("constant", "7")]))
def zero_variance_columns(spark, base):
    df = C.feature_table(spark, base).withColumn("constant", F.lit(7))
    return P.zero_variance_columns(df, [*ALL_NUMERIC, "constant"])


_HASH = common.key_hash("customer_id")


@query("stratified_split", ctes=("c360",), sql=f"""
SELECT customer_id, churned, CASE WHEN rn <= (n * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS part FROM (
  SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY {_HASH}, customer_id) AS rn,
    count(*) OVER (PARTITION BY churned) AS n FROM c360)""")
def stratified_split(spark, base):
    df = C.feature_table(spark, base).select("customer_id", "churned")
    return SP.stratified_split(df, "customer_id", "churned")


@query("stratified_split_text_key", ctes=("c360",), sql=f"""
SELECT customer_ref, churned, CASE WHEN rn <= (n * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS part FROM (
  SELECT customer_ref, churned, row_number() OVER (PARTITION BY churned ORDER BY {common.key_hash('customer_ref')}) AS rn,
    count(*) OVER (PARTITION BY churned) AS n FROM (SELECT customer_id - 700 || '-VHVEG' AS customer_ref, churned FROM c360))""")
def stratified_split_text_key(spark, base):
    ref = F.concat((F.col("customer_id") - 700).cast("string"), F.lit("-VHVEG")).alias("customer_ref")
    return SP.stratified_split(C.feature_table(spark, base).select(ref, "churned"), "customer_ref", "churned")


@query("stratified_split_3way", ctes=("c360",), sql=f"""
SELECT customer_id, churned, CASE WHEN rn <= (n * 70 + 99) // 100 THEN 'train' WHEN rn <= (n * 85 + 99) // 100 THEN 'val' ELSE 'test' END AS part FROM (
  SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY {_HASH}, customer_id) AS rn,
    count(*) OVER (PARTITION BY churned) AS n FROM c360)""")
def stratified_split_3way(spark, base):
    df = C.feature_table(spark, base).select("customer_id", "churned")
    return SP.stratified_split_3way(df, "customer_id", "churned")


@query("kfold_assign", ctes=("c360",), sql=f"""
SELECT customer_id, churned, CAST(CASE WHEN rn <= (n * 1 + 4) // 5 THEN 0 WHEN rn <= (n * 2 + 4) // 5 THEN 1
  WHEN rn <= (n * 3 + 4) // 5 THEN 2 WHEN rn <= (n * 4 + 4) // 5 THEN 3 ELSE 4 END AS INTEGER) AS fold FROM (
  SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY {_HASH}, customer_id) AS rn,
    count(*) OVER (PARTITION BY churned) AS n FROM c360)""")
def kfold_assign(spark, base):
    df = C.feature_table(spark, base).select("customer_id", "churned")
    return SP.kfold(df, "customer_id", "churned", 5)


@query("binary_columns", ctes=("c360",), sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT CAST({c} AS VARCHAR)) <= 2 AND
  count(CASE WHEN CAST({c} AS VARCHAR) NOT IN ('0','1','0.0','1.0','true','false','True','False','yes','no','Yes','No') THEN 1 END) = 0 AS is_binary FROM c360"""
    for c in [*ALL_NUMERIC, *ALL_TEXTS, "churned"]))
def binary_columns(spark, base):
    from tidemark.catalog import BINARY_LIKE_VALUES
    cols = [*ALL_NUMERIC, *ALL_TEXTS, "churned"]
    return P.binary_columns(C.feature_table(spark, base), cols, BINARY_LIKE_VALUES)
