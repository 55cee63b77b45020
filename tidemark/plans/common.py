"""Common tables of the oracles: the customer table and the scored table in plain SQL."""

from __future__ import annotations

from tidemark import catalog
from tidemark.plans.registry import define_cte, rnd

T0 = "DATE '2001-02-01'"
INDUSTRY_LIST = "[" + ", ".join(f"'{i}'" for i in catalog.INDUSTRIES) + "]"


def key_hash(key: str) -> str:
    """SQL twin of ``portable_hash``."""
    return f"CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 13) AS BIGINT)"


KEY_HASH = key_hash("c_custkey")

define_cte("li", """
SELECT l_orderkey, sum(CAST(l_discount AS DECIMAL(18,2))) AS discount, count(*) AS n_lines,
       sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned
FROM lineitem GROUP BY l_orderkey""")

define_cte("oa", f"""
SELECT o_custkey,
  min(CASE WHEN o_orderdate < {T0} THEN CAST(o_orderdate AS DATE) END) AS first_order,
  max(CASE WHEN o_orderdate < {T0} THEN CAST(o_orderdate AS DATE) END) AS last_order,
  count(CASE WHEN o_orderdate < {T0} THEN 1 END) AS n_orders,
  sum(CASE WHEN o_orderdate < {T0} THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS spend,
  sum(CASE WHEN o_orderdate < {T0} THEN discount END) AS discount,
  sum(CASE WHEN o_orderdate < {T0} THEN n_lines END) AS n_lines,
  sum(CASE WHEN o_orderdate < {T0} THEN n_returned END) AS n_returned,
  count(CASE WHEN o_orderdate < {T0} AND date_diff('day', CAST(o_orderdate AS DATE), {T0}) <= 180 THEN 1 END) AS orders_180d,
  max(CASE WHEN o_orderdate < {T0} THEN 0 ELSE 1 END) AS active_after
FROM orders LEFT JOIN li ON o_orderkey = l_orderkey GROUP BY o_custkey""", "li")

define_cte("ev", """
SELECT user_id, CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS INTEGER) AS support_tickets_90d,
  CAST(count(CASE WHEN event_type IN ('view', 'click') THEN 1 END) AS INTEGER) AS app_sessions_30d
FROM events GROUP BY user_id""")

define_cte("c360", f"""
SELECT c_custkey AS customer_id,
  {INDUSTRY_LIST}[c_custkey % 10 + 1] AS industry,
  CASE WHEN {KEY_HASH} < {int(0.6 * 2**52)} THEN 'train' WHEN {KEY_HASH} < {int(0.8 * 2**52)} THEN 'val' ELSE 'test' END AS split,
  r_name AS region, c_mktsegment AS customer_segment,
  CAST(year(first_order) AS INTEGER) AS signup_year,
  CAST(date_diff('day', first_order, {T0}) // 30 AS INTEGER) AS tenure_months,
  CAST(spend AS DOUBLE) / greatest(date_diff('day', first_order, {T0}) // 30, 1) AS monthly_spend_usd,
  CAST(oa.discount AS DOUBLE) / oa.n_lines AS discount_pct,
  CAST(oa.n_returned AS DOUBLE) / oa.n_lines AS return_rate,
  CAST(date_diff('day', last_order, {T0}) AS INTEGER) AS days_since_last_activity,
  CASE WHEN n_orders > 0 THEN CAST(orders_180d AS INTEGER) END AS orders_180d,
  CASE WHEN n_orders > 0 THEN CAST(spend AS DOUBLE) / n_orders END AS avg_order_value_usd,
  support_tickets_90d, app_sessions_30d, c_acctbal AS avg_balance_usd,
  ['month_to_month', 'annual', 'two_year'][c_custkey % 3 + 1] AS contract_type,
  ['bronze', 'silver', 'gold', 'platinum'][(c_custkey // 10) % 4 + 1] AS loyalty_tier,
  ['member', 'silver', 'gold'][(c_custkey // 10) % 3 + 1] AS membership_level,
  CAST((c_custkey * 7) % 11 AS INTEGER) AS nps_score,
  CAST((c_custkey * 37) % 101 AS DOUBLE) / 100.0::DOUBLE AS feature_adoption_score,
  CAST((c_custkey * 53) % 101 AS DOUBLE) / 100.0::DOUBLE AS cart_abandon_rate,
  CAST((c_custkey * 71) % 101 AS DOUBLE) / 100.0::DOUBLE AS completion_rate,
  CAST((c_custkey * 3) % 7 % 5 AS INTEGER) AS missed_appointments_12m,
  CAST((c_custkey // 10) % 4 AS INTEGER) AS agent_contact_90d,
  CAST((c_custkey // 10) % 2 AS INTEGER) AS smart_meter_enabled,
  CAST((c_custkey // 7) % 4 AS INTEGER) AS overdrafts_12m,
  CAST((c_custkey // 3) % 10 AS INTEGER) AS dropped_calls_30d,
  CAST(1 - coalesce(active_after, 0) AS INTEGER) AS churned
FROM customer LEFT JOIN oa ON c_custkey = o_custkey LEFT JOIN ev ON c_custkey = user_id
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey
""", "oa", "ev")


def risk_sql(**replaced: str) -> str:
    """SQL twin of the fixed-coefficient risk; keyword arguments replace inputs."""
    c = lambda name: replaced.get(name, name)
    effect = f"""CASE industry
    WHEN 'telecom' THEN CASE {c('contract_type')} WHEN 'month_to_month' THEN 0.8::DOUBLE WHEN 'annual' THEN -0.4::DOUBLE WHEN 'two_year' THEN -0.2::DOUBLE ELSE 0.3::DOUBLE END
    WHEN 'saas' THEN 1.5::DOUBLE * (0.5::DOUBLE - {c('feature_adoption_score')})
    WHEN 'retail' THEN CASE {c('loyalty_tier')} WHEN 'gold' THEN -0.5::DOUBLE WHEN 'platinum' THEN -0.6::DOUBLE ELSE 0.3::DOUBLE END
    WHEN 'banking' THEN -0.0001::DOUBLE * ({c('avg_balance_usd')} - 5000.0::DOUBLE)
    WHEN 'ecommerce' THEN 1.2::DOUBLE * ({c('cart_abandon_rate')} - 0.3::DOUBLE)
    WHEN 'education' THEN 1.2::DOUBLE * (0.6::DOUBLE - {c('completion_rate')})
    WHEN 'healthcare' THEN 0.25::DOUBLE * ({c('missed_appointments_12m')}::DOUBLE - 1.0::DOUBLE)
    WHEN 'hospitality' THEN CASE {c('membership_level')} WHEN 'gold' THEN -0.6::DOUBLE WHEN 'silver' THEN -0.2::DOUBLE ELSE 0.3::DOUBLE END
    WHEN 'insurance' THEN 0.3::DOUBLE - 0.3::DOUBLE * least({c('agent_contact_90d')}, 2)::DOUBLE
    WHEN 'utilities' THEN 0.3::DOUBLE - 0.5::DOUBLE * {c('smart_meter_enabled')}::DOUBLE END"""
    z = f"""(0.1::DOUBLE - 0.35::DOUBLE * (coalesce({c('orders_180d')}, 5)::DOUBLE - 0.75::DOUBLE)
    + 0.002::DOUBLE * (coalesce({c('days_since_last_activity')}, 15)::DOUBLE - 240.0::DOUBLE)
    + 0.02::DOUBLE * (coalesce({c('support_tickets_90d')}, 1)::DOUBLE - 1.0::DOUBLE)
    + 0.8::DOUBLE * (coalesce({c('return_rate')}, 0.05::DOUBLE) - 0.33::DOUBLE)
    + {effect})"""
    return rnd(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{z}))", 6)


define_cte("full_scored", f"SELECT *, {risk_sql()} AS p FROM c360", "c360")
define_cte("scored", "SELECT customer_id, industry, split, churned, p FROM full_scored", "full_scored")
