"""The customer table the engine runs on, derived from the transactional tables.

Features are taken as of ``AS_OF``; the label says whether the customer placed no
order afterwards.  Money sums run in decimal arithmetic, so every feature is exact and
independent of how the rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars as S
from tidemark.sources.tables import stored, table

AS_OF = "2001-02-01"
TRAIN_SHARE, VAL_SHARE = 0.6, 0.2
KNN_FEATURES = [
    "tenure_months", "monthly_spend_usd", "discount_pct", "return_rate",
    "days_since_last_activity", "orders_180d", "avg_order_value_usd", "avg_balance_usd",
]
SCORE_INPUTS = [
    "orders_180d", "days_since_last_activity", "support_tickets_90d", "return_rate",
    *dict.fromkeys(f for f, _, _ in catalog.INTERVENTIONS.values()),
]


def order_facts(spark: SparkSession, base: str) -> DataFrame:
    """One row per customer with order and line totals before ``AS_OF``.

    Lines are summed per order before they meet the orders, so the join moves one row per
    order whatever the number of lines, and a customer holding a large share of all orders
    is reduced by partial aggregation.
    """
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    lines = (
        table(spark, base, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("discount"),
            F.count(F.lit(1)).alias("n_lines"),
            F.sum((F.col("l_returnflag") == "R").cast("int")).alias("n_returned"),
        )
    )
    before = F.col("o_orderdate") < as_of
    orders = (
        table(spark, base, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )

    def pre(x: Column) -> Column:
        return F.when(before, x)

    recent = before & (F.datediff(as_of, F.col("o_orderdate")) <= 180)
    return orders.groupBy("o_custkey").agg(
        F.min(pre(F.col("o_orderdate"))).alias("first_order"),
        F.max(pre(F.col("o_orderdate"))).alias("last_order"),
        F.count(pre(F.lit(1))).alias("n_orders"),
        F.sum(pre(F.col("o_totalprice").cast("decimal(18,2)"))).alias("spend"),
        F.sum(pre(F.col("discount"))).alias("discount"),
        F.sum(pre(F.col("n_lines"))).alias("n_lines"),
        F.sum(pre(F.col("n_returned"))).alias("n_returned"),
        F.count(F.when(recent, 1)).alias("orders_180d"),
        F.max((~before).cast("int")).alias("active_after"),
    )


def event_facts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").groupBy("user_id").agg(
        F.count(F.when(F.col("event_type") == "error", 1)).cast("int").alias("support_tickets_90d"),
        F.count(F.when(F.col("event_type").isin("view", "click"), 1)).cast("int").alias("app_sessions_30d"),
    )


def attribute_columns(key: Column) -> dict[str, Column]:
    """Profile attributes that the transactional tables lack, as a rule over the key."""
    def pick(index: Column, *names: str) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))

    def div(n: int) -> Column:
        return F.floor(key / n)

    return {
        "contract_type": pick(key % 3, "month_to_month", "annual", "two_year"),
        "loyalty_tier": pick(div(10) % 4, "bronze", "silver", "gold", "platinum"),
        "membership_level": pick(div(10) % 3, "member", "silver", "gold"),
        "nps_score": ((key * 7) % 11).cast("int"),
        "feature_adoption_score": ((key * 37) % 101).cast("double") / F.lit(100.0),
        "cart_abandon_rate": ((key * 53) % 101).cast("double") / F.lit(100.0),
        "completion_rate": ((key * 71) % 101).cast("double") / F.lit(100.0),
        "missed_appointments_12m": ((key * 3) % 7 % 5).cast("int"),
        "agent_contact_90d": (div(10) % 4).cast("int"),
        "smart_meter_enabled": (div(10) % 2).cast("int"),
        "overdrafts_12m": (div(7) % 4).cast("int"),
        "dropped_calls_30d": (div(3) % 10).cast("int"),
    }


def split_of(key: Column) -> Column:
    """Row-wise 60/20/20 split by key hash: no shuffle, stable under appends."""
    h = S.portable_hash(key)
    return (
        F.when(h < int(TRAIN_SHARE * 2 ** S.HASH_BITS), "train")
        .when(h < int((TRAIN_SHARE + VAL_SHARE) * 2 ** S.HASH_BITS), "val")
        .otherwise("test")
    )


def industry_of(key: Column) -> Column:
    names = F.array(*[F.lit(i) for i in catalog.INDUSTRIES])
    return F.element_at(names, (key % len(catalog.INDUSTRIES) + 1).cast("int"))


def customer_360(spark: SparkSession, base: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    geo = (
        table(spark, base, "nation")
        .join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("region"))
    )
    key = F.col("c_custkey")
    tenure = F.floor(F.datediff(as_of, F.col("first_order")) / 30).cast("int")
    joined = (
        table(spark, base, "customer")
        .join(order_facts(spark, base), key == F.col("o_custkey"), "left")
        .join(event_facts(spark, base), key == F.col("user_id"), "left")
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    has_orders = F.col("n_orders") > 0
    return joined.select(
        key.alias("customer_id"),
        industry_of(key).alias("industry"),
        split_of(key).alias("split"),
        "region",
        F.col("c_mktsegment").alias("customer_segment"),
        F.year("first_order").alias("signup_year"),
        tenure.alias("tenure_months"),
        (F.col("spend").cast("double") / F.greatest(tenure, F.lit(1))).alias("monthly_spend_usd"),
        (F.col("discount").cast("double") / F.col("n_lines")).alias("discount_pct"),
        (F.col("n_returned").cast("double") / F.col("n_lines")).alias("return_rate"),
        F.datediff(as_of, F.col("last_order")).alias("days_since_last_activity"),
        F.when(has_orders, F.col("orders_180d").cast("int")).alias("orders_180d"),
        F.when(has_orders, F.col("spend").cast("double") / F.col("n_orders")).alias("avg_order_value_usd"),
        "support_tickets_90d",
        "app_sessions_30d",
        F.col("c_acctbal").alias("avg_balance_usd"),
        *[c.alias(n) for n, c in attribute_columns(key).items()],
        (F.lit(1) - F.coalesce(F.col("active_after"), F.lit(0))).alias("churned"),
    )


def feature_table(spark: SparkSession, base: str) -> DataFrame:
    """``customer_360`` written once to the shared folder and read back.

    Operators that pass over the customers several times (medians, scaling, retrieval,
    model fitting) start here, so orders and lines are joined once and the table outlives
    any executor.
    """
    inputs = ("customer", "orders", "lineitem", "events", "nation", "region")
    return stored(spark, base, "customers", inputs, customer_360)


def action_effect(industry: Column, c: dict[str, Column]) -> Column:
    """Contribution of the industry's actionable feature to the risk logit."""
    tier = lambda x, **w: F.coalesce(
        F.create_map(*[F.lit(v) for kv in w.items() for v in kv])[x], F.lit(0.3))
    by_industry = {
        "telecom": tier(c["contract_type"], month_to_month=0.8, annual=-0.4, two_year=-0.2),
        "saas": F.lit(1.5) * (F.lit(0.5) - c["feature_adoption_score"]),
        "retail": tier(c["loyalty_tier"], gold=-0.5, platinum=-0.6),
        "banking": F.lit(-0.0001) * (c["avg_balance_usd"] - F.lit(5000.0)),
        "ecommerce": F.lit(1.2) * (c["cart_abandon_rate"] - F.lit(0.3)),
        "education": F.lit(1.2) * (F.lit(0.6) - c["completion_rate"]),
        "healthcare": F.lit(0.25) * (c["missed_appointments_12m"].cast("double") - F.lit(1.0)),
        "hospitality": tier(c["membership_level"], gold=-0.6, silver=-0.2),
        "insurance": F.lit(0.3) - F.lit(0.3) * F.least(c["agent_contact_90d"], F.lit(2)).cast("double"),
        "utilities": F.lit(0.3) - F.lit(0.5) * c["smart_meter_enabled"].cast("double"),
    }
    out = F.lit(0.0)
    for name, effect in by_industry.items():
        out = F.when(industry == name, effect).otherwise(out)
    return out


def risk_score(industry: Column, c: dict[str, Column]) -> Column:
    """Fixed-coefficient logistic risk, to six decimals.

    A transparent stand-in for a fitted model wherever a result has to be reproducible in
    SQL; fitted models plug into the same downstream operators.
    """
    z = (
        F.lit(0.1)
        - F.lit(0.35) * (F.coalesce(c["orders_180d"], F.lit(5)).cast("double") - F.lit(0.75))
        + F.lit(0.002) * (F.coalesce(c["days_since_last_activity"], F.lit(15)).cast("double") - F.lit(240.0))
        + F.lit(0.02) * (F.coalesce(c["support_tickets_90d"], F.lit(1)).cast("double") - F.lit(1.0))
        + F.lit(0.8) * (F.coalesce(c["return_rate"], F.lit(0.05)) - F.lit(0.33))
        + action_effect(industry, c)
    )
    return S.stable_round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


def with_risk(df: DataFrame, name: str = "p") -> DataFrame:
    return df.withColumn(name, risk_score(F.col("industry"), {c: F.col(c) for c in SCORE_INPUTS}))


def scored_customers(spark: SparkSession, base: str) -> DataFrame:
    """(customer_id, industry, split, churned, p) with pruned inputs."""
    return with_risk(feature_table(spark, base)).select("customer_id", "industry", "split", "churned", "p")
