"""Time-to-churn: risk sets and Cox proportional hazards by group.

Durations are whole months, so a group has at most a few hundred distinct ones.  A Newton step is
two passes over the written rows: vectors by group and duration, then one matrix a group; both are
added up within a partition as matrices, and only the sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, pin

PENALIZER = 0.1


def risk_sets(df: DataFrame, by: Sequence[str], duration: str = "tenure_months", event: str = "churned") -> DataFrame:
    """(*by, duration, leaving, events, at_risk): subjects with a duration of at least t."""
    per = df.where(F.col(duration).isNotNull()).groupBy(*by, F.col(duration).cast("int").alias("duration")).agg(
        F.count(F.lit(1)).alias("leaving"), F.count(F.when(F.col(event) == 1, 1)).alias("events"))
    w = Window.partitionBy(*by).orderBy(F.col("duration").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("at_risk", F.sum("leaving").over(w))


def _summed(parts: DataFrame, keys: Sequence[str]) -> list:
    """Rows (*keys, values) of all partitions, added up by key and place."""
    each = parts.select(*keys, F.posexplode("values").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return each.groupBy(*keys).agg(listed.alias("values")).collect()


def _vectors(df: DataFrame, by: str, x: Sequence[str], betas: dict[str, np.ndarray]) -> dict[str, list[tuple[int, np.ndarray]]]:
    """For each group and duration, the latest first: events, sums of exp(score) and of score, and three sums of covariates.

    A partition adds its rows up as matrices; what is shuffled is one list of numbers for each group and duration in it.
    """
    names = list(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for g, part in batch.groupby(by):
                m = part[names].to_numpy(float)
                score = m @ betas[g]
                e, died = np.exp(score), (part["__event"].to_numpy() == 1).astype(float)
                order = np.argsort(part["__t"].to_numpy(), kind="stable")
                t, first = np.unique(part["__t"].to_numpy()[order], return_index=True)
                columns = np.column_stack([died, e, e * died, score * died, e[:, None] * m, (e * died)[:, None] * m, died[:, None] * m])
                for k, own in zip(t.tolist(), np.add.reduceat(columns[order], first)):
                    found[g, k] = found[g, k] + own if (g, k) in found else own
        if found:
            yield pd.DataFrame({by: [g for g, _ in found], "__t": [t for _, t in found], "values": [v.tolist() for v in found.values()]})

    parts = df.select(by, "__t", "__event", *names).mapInPandas(run, f"{by} string, __t int, values array<double>")
    out: dict[str, list[tuple[int, np.ndarray]]] = {g: [] for g in betas}
    for r in sorted(_summed(parts, [by, "__t"]), key=lambda r: -r["__t"]):
        out[r[by]].append((r["__t"], np.array(r["values"])))
    return out


def _matrices(df: DataFrame, by: str, x: Sequence[str], betas: dict[str, np.ndarray],
              weights: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """For each group the sum of exp(score) x x' over rows, weighted by duration and event: one matrix a group."""
    names, p = list(x), len(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for g, part in batch.groupby(by):
                t, w, less = weights[g]
                m = part[names].to_numpy(float)
                at = np.searchsorted(t, part["__t"].to_numpy())
                scale = np.exp(m @ betas[g]) * (w[at] - less[at] * (part["__event"].to_numpy() == 1))
                found[g] = found.get(g, np.zeros((p, p))) + (m * scale[:, None]).T @ m
        if found:
            yield pd.DataFrame({by: list(found), "values": [v.ravel().tolist() for v in found.values()]})

    parts = df.select(by, "__t", "__event", *names).mapInPandas(run, f"{by} string, values array<double>")
    return {r[by]: np.array(r["values"]).reshape(p, p) for r in _summed(parts, [by])}


#: The last events of one time, whose terms are added one by one; the others by the midpoint rule.
TIED_EVENTS = 4096


def tied(d: int, r0: float, e0: float) -> dict[str, float]:
    """Sums over ``f = 0, 1/d, .. (d-1)/d`` of log s, 1/s, f/s, 1/s^2, f/s^2 and f^2/s^2, ``s = r0 - f e0``.

    The cost does not depend on the number of events: beyond ``TIED_EVENTS`` a sum is the integral from
    half a step before to half a step after with the first correction term, but for the last
    terms, where s may be small.
    """
    near = min(d, TIED_EVENTS)
    s = r0 - np.arange(d - near, d) / d * e0
    log_sum, inv, inv2 = float(np.log(s).sum()), float((1 / s).sum()), float((1 / s ** 2).sum())
    if d > near and e0 > 0:
        step = e0 / d
        a, b = r0 + step / 2, r0 - (d - near - 0.5) * step  # s at both ends, half a step out

        def rule(integral: float, slope) -> float:
            return integral / step - step / 24 * (slope(a) - slope(b))

        log_sum += rule(a * math.log(a) - a - b * math.log(b) + b, lambda s: 1 / s)
        inv += rule(math.log(a / b), lambda s: -1 / s ** 2)
        inv2 += rule(1 / b - 1 / a, lambda s: -2 / s ** 3)
    if e0 <= 0:
        log_sum, inv, inv2 = d * math.log(r0), d / r0, d / r0 ** 2
        f = (d - 1) / 2
        return {"log": log_sum, "inv": inv, "f_inv": f / r0, "inv2": inv2, "f_inv2": f / r0 ** 2,
                "ff_inv2": (d - 1) * (2 * d - 1) / (6 * d) / r0 ** 2}
    return {"log": log_sum, "inv": inv, "f_inv": (r0 * inv - d) / e0, "inv2": inv2,
            "f_inv2": (r0 * inv2 - inv) / e0, "ff_inv2": (r0 * r0 * inv2 - 2 * r0 * inv + d) / e0 ** 2}


def efron(rows: Sequence[tuple[int, np.ndarray]], p: int):
    """Log partial likelihood, gradient, the part of the Hessian that sums tell, and row weights for the other part.

    The Hessian also needs the sum of exp(score) x x' over all subjects at risk at each event time.  A subject is at
    risk up to its own duration, so over all times it counts with the running total of the times' weights: one
    matrix for the group in place of one for each duration.
    """
    r0, r1 = 0.0, np.zeros(p)
    ll, grad, outer = 0.0, np.zeros(p), np.zeros((p, p))
    inv, less = np.zeros(len(rows)), np.zeros(len(rows))
    for k, (_, v) in enumerate(rows):
        d, e0 = int(v[0]), float(v[2])
        e1, x1 = v[4 + p:4 + 2 * p], v[4 + 2 * p:]
        r0, r1 = r0 + float(v[1]), r1 + v[4:4 + p]
        if d == 0:
            continue
        t = tied(d, r0, e0)
        ll += float(v[3]) - t["log"]
        grad += x1 - t["inv"] * r1 + t["f_inv"] * e1
        cross = np.outer(r1, e1)
        outer += t["inv2"] * np.outer(r1, r1) - t["f_inv2"] * (cross + cross.T) + t["ff_inv2"] * np.outer(e1, e1)
        inv[k], less[k] = t["inv"], t["f_inv"]
    times = np.array([t for t, _ in rows][::-1])
    return ll, grad, outer, (times, np.cumsum(inv[::-1]), less[::-1])


def cox_fit(df: DataFrame, by: str, covariates: Sequence[str], duration: str = "tenure_months",
            event: str = "churned", penalizer: float = PENALIZER, steps: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """(by, covariate, coef, hazard_ratio, se, p, score, converged) for every group.

    ``score`` is the penalised score at the solution, per subject; a step that lowers the penalised
    likelihood is halved; a group that has not settled after ``steps`` says so in ``converged``.

    Efron ties; ridge penalty ``n * penalizer / 2 * |b|^2`` on standardised covariates;
    covariates without variance in a group are left out of it.
    """
    spark = df.sparkSession
    p = len(covariates)
    complete = df.where(F.col(duration).isNotNull() & F.col(by).isNotNull()).select(
        F.col(by).cast("string").alias(by), F.col(duration).cast("int").alias("__t"),
        F.col(event).cast("int").alias("__event"), *[F.col(c).cast("double").alias(c) for c in covariates])
    fitted = pin(complete.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in covariates]).alias("mean"),
        F.array(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)) for c in covariates]).alias("sd")))
    stats = {r[by]: r for r in fitted.collect()}

    def standard(i: int) -> Column:
        sd = F.col("sd")[i]
        return F.coalesce((F.col(covariates[i]) - F.col("mean")[i]) / F.when(sd < 1e-12, F.lit(1.0)).otherwise(sd), F.lit(0.0))

    scaled = complete.join(fitted, by).select(by, "__t", "__event", *[standard(i).alias(c) for i, c in enumerate(covariates)])
    scaled = materialize(scaled, "cox-rows")  # read twice per step
    active = {g: [i for i in range(p) if r.sd[i] >= 1e-12] for g, r in stats.items()}
    betas = {g: np.zeros(p) for g in stats}
    last: dict[str, float] = {}
    moved: dict[str, np.ndarray] = {}
    curvature: dict[str, np.ndarray] = {}
    score: dict[str, np.ndarray] = {}
    settled: set[str] = set()
    open_groups = set(stats)
    for _ in range(steps):
        sums = _vectors(scaled.where(F.col(by).isin(*open_groups)), by, covariates, {g: betas[g] for g in open_groups})
        uphill: dict[str, tuple] = {}
        for g in sorted(open_groups):
            ix = active[g]
            ll, grad, outer, weights = efron(sums[g], p)
            strength = stats[g].n * penalizer
            ll -= strength / 2 * float(betas[g] @ betas[g])
            if g in last and ll < last[g] - 1e-9 * abs(last[g]) and np.abs(moved[g]).max(initial=0.0) > tolerance:
                moved[g] = moved[g] / 2  # too far: back by half
                betas[g][ix] -= moved[g]
                continue
            last[g] = ll
            uphill[g] = grad - strength * betas[g], outer, weights
        if uphill:
            risk = _matrices(scaled.where(F.col(by).isin(*uphill)), by, covariates, {g: betas[g] for g in uphill},
                             {g: w for g, (_, _, w) in uphill.items()})
        for g, (grad, outer, _) in uphill.items():
            ix = active[g]
            grad = grad[ix]
            hess = (outer - risk[g])[np.ix_(ix, ix)] - stats[g].n * penalizer * np.eye(len(ix))
            curvature[g], score[g] = hess, grad / max(1, stats[g].n)
            step = np.linalg.solve(-hess, grad)
            if float(np.linalg.norm(step)) < tolerance:
                settled.add(g)
                open_groups.discard(g)
                continue
            moved[g] = step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max(initial=0.0))))
            betas[g][ix] += moved[g]
        if not open_groups:
            break
    out = []
    for g, r in sorted(stats.items()):
        se = np.sqrt(np.diag(np.linalg.inv(-curvature[g])))
        for pos, i in enumerate(active[g]):
            coef, err = betas[g][i] / r.sd[i], se[pos] / r.sd[i]
            z = abs(coef / err)
            out.append((g, covariates[i], float(coef), float(math.exp(coef)), float(err), math.erfc(z / math.sqrt(2.0)),
                        float(score[g][pos]), g in settled))
    return spark.createDataFrame(out, f"{by} string, covariate string, coef double, hazard_ratio double, se double, "
                                      "p double, score double, converged boolean")


def top_hazards(hazards: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The most significant covariates of each group."""
    w = Window.partitionBy(by).orderBy("p", "covariate")
    return hazards.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
