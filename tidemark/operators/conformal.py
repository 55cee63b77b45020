"""Split-conformal prediction sets: calibration, application and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import stable_round
from tidemark.operators.selection import order_statistics


class CalibrationQualityError(Exception):
    """Empirical coverage is further from a target level than the guardrail allows."""


def nonconformity(p: Column, label: Column) -> Column:
    """One minus the probability of the given class, to six decimals."""
    own = F.when(label == 1, p).otherwise(stable_round(1 - p, 6))
    return stable_round(F.lit(1.0) - own, 6)


def calibrate(df: DataFrame, by: Sequence[str], score: str = "p", label: str = "churned",
              levels: Sequence[int] = catalog.LEVELS_PCT, **kw) -> DataFrame:
    """(*by, level_pct, n, k, qhat): the k-th smallest score with k = ceil((n+1) level).

    When k exceeds n every class is in every set, which qhat = 1 expresses.
    """
    by = list(by)
    scored = df.select(*by, nonconformity(F.col(score), F.col(label)).alias("s"))
    rank = {pct: (lambda n, pct=pct: F.floor(((n + 1) * pct + 99) / 100)) for pct in levels}
    stats = order_statistics(scored, ["s"], by, {str(pct): (pct / 100.0, rank[pct]) for pct in levels}, **kw)
    pct = F.col("target").cast("int")
    return stats.select(
        *by, pct.alias("level_pct"), "n",
        F.floor(((F.col("n") + 1) * pct + 99) / 100).alias("k"),
        F.coalesce("value", F.lit(1.0)).alias("qhat"),
    )


def in_set(p: Column, qhat: Column) -> tuple[Column, Column]:
    """Whether class 0 and class 1 belong to the prediction set."""
    cut = stable_round(1 - qhat, 6)
    return stable_round(1 - p, 6) >= cut, stable_round(p, 6) >= cut


def prediction_sets(df: DataFrame, quantiles: DataFrame, by: Sequence[str], score: str = "p",
                    level_pct: int | None = None) -> DataFrame:
    """Rows x levels with ``in0`` and ``in1``; one level only when ``level_pct`` is given.

    The quantile table has a handful of rows per group of a fixed vocabulary; broadcast.
    """
    q = quantiles.select(*by, "level_pct", "qhat")
    if level_pct is not None:
        q = q.where(F.col("level_pct") == level_pct)
    in0, in1 = in_set(F.col(score), F.col("qhat"))
    return df.join(F.broadcast(q), list(by)).withColumns({"in0": in0, "in1": in1})


def coverage(sets: DataFrame, by: Sequence[str], label: str = "churned") -> DataFrame:
    """Share of rows whose label is in the set, and the average set size."""
    hit = F.when(F.col(label) == 1, F.col("in1")).otherwise(F.col("in0")).cast("double")
    size = F.col("in0").cast("int") + F.col("in1").cast("int")
    return sets.groupBy(*by, "level_pct").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("coverage"), F.avg(size).alias("avg_set_size"))


def set_distribution(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Decided rows per class; empty and two-class sets are uncertain."""
    return sets.groupBy(*by, "level_pct").agg(
        F.count(F.when(F.col("in0") & ~F.col("in1"), 1)).alias("retained"),
        F.count(F.when(F.col("in1") & ~F.col("in0"), 1)).alias("churned"),
        F.count(F.when(F.col("in0") == F.col("in1"), 1)).alias("uncertain"),
    )


def business_impact(distribution: DataFrame) -> DataFrame:
    cost = (F.col("churned") + F.col("uncertain")) * catalog.OUTREACH_COST
    saved = F.col("churned") * catalog.SAVED_CHURNED + F.col("uncertain") * catalog.SAVED_UNCERTAIN
    return distribution.withColumns({
        "outreach_cost": cost, "saved_value": saved, "net_benefit": saved - cost})


def confident_rate(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Percentage of rows with exactly one class in their set."""
    decided = (F.col("in0") != F.col("in1")).cast("double")
    return sets.groupBy(*by, "level_pct").agg((F.avg(decided) * 100).alias("confident_rate"))


def guardrail(cov: DataFrame, tolerance: float = catalog.GUARDRAIL) -> DataFrame:
    deviation = F.abs(F.col("coverage") - F.col("level_pct") / 100.0)
    return cov.withColumns({"deviation": deviation, "passed": stable_round(deviation, 9) <= tolerance})


def require_guardrail(cov: DataFrame, tolerance: float = catalog.GUARDRAIL) -> None:
    """Raise when any group and level breaches the guardrail."""
    bad = guardrail(cov, tolerance).where(~F.col("passed")).orderBy(F.col("deviation").desc()).limit(5).collect()
    if bad:
        raise CalibrationQualityError("; ".join(
            f"target coverage {r['level_pct']}%, empirical {r['coverage']:.4f}" for r in bad))
