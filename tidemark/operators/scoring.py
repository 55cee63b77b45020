"""Batch scoring: probability, prediction set, evidence and what-if in one lazy table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import (
    action_tier, blend_proxy, blend_retrieval, set_label, stable_round,
)
from tidemark.operators.conformal import in_set

Scorer = Callable[[DataFrame, str], DataFrame]


def optimum(industry: str, x: Column | None) -> Column:
    """The improved value of an industry's actionable feature."""
    value = catalog.INTERVENTIONS[industry][1]
    if isinstance(value, str) and value.startswith("+"):
        gain = F.lit(float(value[1:]))
        return gain if x is None else F.coalesce(x.cast("double"), F.lit(0.0)) + gain
    return F.lit(value)


def intervene(df: DataFrame, industry: str | None = None) -> DataFrame:
    """Replace the actionable feature by its optimum, per row's ``industry`` or for one."""
    changed: dict[str, Column] = {}
    have = set(df.columns)
    for ind, (feature, _, _) in catalog.INTERVENTIONS.items():
        if industry is not None and ind != industry:
            continue
        x = changed.get(feature, F.col(feature) if feature in have else None)
        new = optimum(ind, x)
        if industry is None:
            new = F.when(F.col("industry") == ind, new).otherwise(x)
        changed[feature] = new.cast(df.schema[feature].dataType) if feature in have else new
    return df.withColumns(changed)


def with_what_if(df: DataFrame, industry: str, scorer: Scorer) -> DataFrame:
    """``p_base`` and ``p_improved`` side by side, without a second pass over the rows."""
    feature = catalog.INTERVENTIONS[industry][0]
    scored = scorer(df, "p_base")
    improved = intervene(scored.withColumn("__before", F.col(feature)), industry)
    out = scorer(improved, "p_improved")
    return out.withColumn(feature, F.col("__before")).drop("__before")


def score_rows(df: DataFrame, key: str, industry: str, scorer: Scorer, qhat: float | Column,
               retrieval: DataFrame | None = None, proxy: str | None = None, overlap: float = 1.0) -> DataFrame:
    """Add the decision columns to cleaned rows.

    The sets use the model's own probability; the reported probability is blended with the
    neighbours' vote.  The what-if repeats both for the improved feature and keeps the vote.
    """
    out = with_what_if(df, industry, scorer)
    main = F.col("p_base") if proxy is None else blend_proxy(F.col("p_base"), F.col(proxy), F.lit(overlap))
    if retrieval is not None:
        out = out.join(retrieval.select(F.col("qid").alias(key), "p_retrieval", "avg_similarity", "sources"), key, "left")
    else:
        out = out.withColumns({"p_retrieval": F.lit(None).cast("double"), "avg_similarity": F.lit(None).cast("double"),
                               "sources": F.lit(None).cast("array<string>")})
    q = F.lit(float(qhat)) if not isinstance(qhat, Column) else qhat
    in0, in1 = in_set(F.col("p_base"), q)
    opt0, opt1 = in_set(F.col("p_improved"), q)
    return out.withColumns({
        "p_final": blend_retrieval(main, F.col("p_retrieval")),
        "p_opt_final": blend_retrieval(F.col("p_improved"), F.col("p_retrieval")),
        "in0": in0, "in1": in1, "opt_in0": opt0, "opt_in1": opt1,
    })


def decisions(scored: DataFrame, keep: list[Column]) -> DataFrame:
    """The decision report: uploaded columns plus both scenarios."""
    return scored.select(
        *keep,
        stable_round(F.col("p_final") * 100, 2).alias("churn_probability_pct"),
        set_label(F.col("in0"), F.col("in1")).alias("conformal_prediction_set"),
        action_tier(F.col("in0"), F.col("in1")).alias("recommended_business_action"),
        F.col("sources"),
        stable_round(F.col("p_opt_final") * 100, 2).alias("opt_churn_probability_pct"),
        set_label(F.col("opt_in0"), F.col("opt_in1")).alias("opt_conformal_prediction_set"),
        action_tier(F.col("opt_in0"), F.col("opt_in1")).alias("opt_recommended_business_action"),
    )


def batch_summary(scored: DataFrame) -> DataFrame:
    """Totals of a scored batch in one aggregate row."""
    tier = action_tier(F.col("in0"), F.col("in1"))
    row = scored.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(tier != "No Intervention", 1)).alias("standout_records"),
        stable_round(F.avg((F.col("in0") != F.col("in1")).cast("double")) * 100, 1).alias("batch_confident_rate"),
        stable_round(F.avg("p_final") * 100, 1).alias("avg_churn_risk"),
        stable_round(F.avg("p_opt_final") * 100, 1).alias("avg_optimized_risk"),
    )
    gain = F.greatest(F.lit(0.0), F.col("avg_churn_risk") - F.col("avg_optimized_risk"))
    return row.withColumn("risk_reduction", stable_round(gain, 1))
