"""Preprocessing and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import stable_round
from tidemark.operators import impute as I
from tidemark.operators import preprocess as PP
from tidemark.operators.selection import medians
from tidemark.plans import common  # noqa: F401
from tidemark.plans.registry import define_cte, query, rnd
from tidemark.session import pin
from tidemark.sources import customers as C

SCALED = C.KNN_FEATURES

define_cte("knn_stats", "SELECT industry, " + ", ".join(
    f"coalesce(median(CASE WHEN split = 'train' THEN {c} END), 0) AS md_{c}" for c in SCALED
) + " FROM c360 GROUP BY industry", "c360")
define_cte("knn_moments", "SELECT industry, " + ", ".join(
    f"avg(coalesce({c}, md_{c})::DOUBLE) AS mu_{c}, CASE WHEN stddev_pop(coalesce({c}, md_{c})::DOUBLE) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, md_{c})::DOUBLE) END AS sd_{c}"
    for c in SCALED
) + " FROM c360 JOIN knn_stats USING (industry) WHERE split = 'train' GROUP BY industry", "c360", "knn_stats")
define_cte("scaled", "SELECT c360.* EXCLUDE (" + ", ".join(SCALED) + "), " + ", ".join(
    f"(coalesce({c}, md_{c})::DOUBLE - mu_{c}) / sd_{c} AS {c}" for c in SCALED
) + " FROM c360 JOIN knn_stats USING (industry) JOIN knn_moments USING (industry)", "c360", "knn_stats", "knn_moments")


def scaled_customers(spark, base):
    """All customers with the retrieval features scaled by their industry's train split."""
    df = C.feature_table(spark, base)
    stats = pin(PP.scaling_stats(df.where(F.col("split") == "train"), SCALED, ["industry"]))
    return PP.standard_scale(df, stats, SCALED, ["industry"])


@query("standard_scale", ctes=("scaled",), sql="SELECT customer_id, " + ", ".join(
    f"{rnd(c, 6)} AS {c}" for c in SCALED) + " FROM scaled")
def standard_scale(spark, base):
    out = scaled_customers(spark, base)
    return out.select("customer_id", *[stable_round(F.col(c), 6).alias(c) for c in SCALED])


_IMP_NUM, _IMP_CAT = ["tenure_months", "support_tickets_90d", "app_sessions_30d"], ["region", "loyalty_tier"]


@query("impute_median_mode", ctes=("c360",), sql=f"""
SELECT customer_id, {', '.join(f"coalesce(g.{c}::DOUBLE, median(g.{c}) OVER (PARTITION BY industry), 0) AS {c}" for c in _IMP_NUM)},
  {', '.join(f"coalesce(g.{c}, m_{c}) AS {c}" for c in _IMP_CAT)}
FROM (SELECT * REPLACE (CASE WHEN customer_id % 5 = 0 THEN NULL ELSE region END AS region) FROM c360) g
{' '.join(f'''LEFT JOIN (SELECT industry, {c} AS m_{c} FROM (SELECT industry, {c}, row_number() OVER (PARTITION BY industry ORDER BY count(*) DESC, {c}) AS rk
  FROM (SELECT * REPLACE (CASE WHEN customer_id % 5 = 0 THEN NULL ELSE region END AS region) FROM c360) WHERE {c} IS NOT NULL GROUP BY industry, {c}) WHERE rk = 1) t_{c} USING (industry)''' for c in _IMP_CAT)}""")
def impute_median_mode(spark, base):
    df = C.feature_table(spark, base).withColumn(
        "region", F.when(F.col("customer_id") % 5 != 0, F.col("region")))
    return PP.impute_median_mode(df, _IMP_NUM, _IMP_CAT, ["industry"]).select("customer_id", *_IMP_NUM, *_IMP_CAT)


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_TIERS = ["bronze", "gold", "platinum", "silver"]


@query("one_hot", ctes=("c360",), sql="SELECT customer_id, " + ", ".join(
    f"coalesce(CAST({c} = '{v}' AS INTEGER), 0)::DOUBLE AS \"{c}_{v}\"" for c, vs in (("region", _REGIONS), ("loyalty_tier", _TIERS)) for v in vs
) + " FROM c360")
def one_hot(spark, base):
    df = C.feature_table(spark, base).select("customer_id", "region", "loyalty_tier", "split")
    levels = PP.category_levels(df.where(F.col("split") == "train"), ["region", "loyalty_tier"])
    return PP.one_hot(df.drop("split"), levels)


@query("dummy_encode", ctes=("c360",), sql="SELECT customer_id, " + ", ".join(
    f"coalesce(CAST({c} = '{v}' AS INTEGER), 0)::DOUBLE AS \"{c}_{v}\"" for c, vs in (("region", _REGIONS), ("loyalty_tier", _TIERS)) for v in vs[1:]
) + " FROM c360")
def dummy_encode(spark, base):
    df = C.feature_table(spark, base).select("customer_id", "region", "loyalty_tier")
    return PP.one_hot(df, PP.category_levels(df, ["region", "loyalty_tier"]), drop_first=True)


_GRAM = ["tenure_months", "monthly_spend_usd", "orders_180d", "avg_order_value_usd"]


@query("gram_matrix", ctes=("c360",), sql=" UNION ALL ".join(
    f"SELECT industry, '{a}' AS a, '{b}' AS b, {rnd(f'sum((coalesce({a}, md_{a})) * (coalesce({b}, md_{b}))::DOUBLE) / count(*)', 2)} AS mean_product FROM f GROUP BY industry"
    for i, a in enumerate(_GRAM) for b in _GRAM[i:]).join([
        "SELECT * FROM (WITH f AS (SELECT *, " + ", ".join(f"median({c}) OVER (PARTITION BY industry) AS md_{c}" for c in _GRAM) + " FROM c360) ", ")"]))
def gram_matrix(spark, base):
    df = C.feature_table(spark, base)
    fills = PP.widen(medians(df, _GRAM, ["industry"]), ["industry"], _GRAM, "median")
    joined = df.join(F.broadcast(fills), "industry")
    g = I.gram_table(joined, _GRAM, {c: F.col(f"__median_{c}") for c in _GRAM}, ["industry"], shift=False)
    pairs = [(a, b) for i, a in enumerate(_GRAM) for b in _GRAM[i:]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                               stable_round(F.col("gram")[i] / F.col("n"), 2).alias("mean_product"))
                      for i, (a, b) in enumerate(pairs)])
    return g.select("industry", F.inline(cells))


_T, _P1, _P2 = "avg_order_value_usd", "monthly_spend_usd", "tenure_months"


@query("ridge_impute", ctes=("c360",), sql=f"""
SELECT customer_id, {rnd(f'greatest(my + b1 * (coalesce({_P1}, d1) - m1) + b2 * (coalesce({_P2}, d2) - m2), 0)', 2)} AS {_T}
FROM c360 JOIN (
  SELECT *, ((s22 + 1) * s1y - s12 * s2y) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b1,
            ((s11 + 1) * s2y - s12 * s1y) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b2
  FROM (SELECT industry, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, any_value(d1) AS d1, any_value(d2) AS d2,
      var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12,
      covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y
    FROM (SELECT industry, d1, d2, coalesce({_P1}, d1)::DOUBLE AS x1, coalesce({_P2}, d2)::DOUBLE AS x2, coalesce({_T}, dy)::DOUBLE AS y
      FROM (SELECT *, median({_P1}) OVER w AS d1, median({_P2}) OVER w AS d2, median({_T}) OVER w AS dy
        FROM c360 WHERE split = 'train' WINDOW w AS (PARTITION BY industry))) GROUP BY industry)) USING (industry)
WHERE split = 'test'""")
def ridge_impute(spark, base):
    df = C.feature_table(spark, base)
    cols = [_T, _P1, _P2]
    train = df.where(F.col("split") == "train").select("industry", *cols)
    fills = PP.widen(medians(train, cols, ["industry"]), ["industry"], cols, "median")
    joined = train.join(F.broadcast(fills), "industry")
    g = I.gram_table(joined, cols, {c: F.col(f"__median_{c}") for c in cols}, ["industry"])
    fitted = []  # one row per industry of the fixed vocabulary
    for r in g.join(fills, "industry").collect():
        b0, beta = I.solve_ridge(r.n, r.sums, r.gram, 0, [1, 2])
        fitted.append((r.industry, b0 + r[f"__median_{_T}"], float(beta[0]), float(beta[1]),
                       r[f"__median_{_P1}"], r[f"__median_{_P2}"]))
    coef = spark.createDataFrame(fitted, "industry string, b0 double, b1 double, b2 double, d1 double, d2 double")
    x = lambda c, d: F.coalesce(F.col(c).cast("double"), F.col(d)) - F.col(d)
    value = F.col("b0") + F.col("b1") * x(_P1, "d1") + F.col("b2") * x(_P2, "d2")
    return df.where(F.col("split") == "test").join(F.broadcast(coef), "industry").select(
        "customer_id", stable_round(F.greatest(value, F.lit(0.0)), 2).alias(_T))
