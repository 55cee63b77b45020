"""Correlation imputation: every ridge regression from one Gram matrix aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import to_number
from tidemark.operators.selection import medians, modes

MIN_PREDICTORS = 2


def gram_table(df: DataFrame, columns: Sequence[str], fills: dict[str, float | Column],
               by: Sequence[str] = (), shift: bool = True) -> DataFrame:
    """(*by, n, sums[p], gram[p(p+1)/2]) of the filled columns in one pass.

    Values are shifted by their fill value (the median), which leaves the centred cross
    products unchanged and avoids cancellation between large raw moments.
    """
    x = []
    for c in columns:
        fill = fills[c] if isinstance(fills[c], Column) else F.lit(float(fills[c]))
        v = F.coalesce(F.col(c).cast("double"), fill)
        x.append(v - fill if shift else v)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(v) for v in x]).alias("sums"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]).alias("gram"),
    )


def solve_ridge(n: int, sums: Sequence[float], gram: Sequence[float], target: int,
                predictors: Sequence[int], alpha: float = 1.0) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of a ridge with unpenalised intercept, in shifted units."""
    p = len(sums)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = gram
    full = full + np.triu(full, 1).T
    s = np.asarray(sums, dtype=float)
    centred = full - np.outer(s, s) / n
    pick = list(predictors)
    beta = np.linalg.solve(centred[np.ix_(pick, pick)] + alpha * np.eye(len(pick)), centred[pick, target])
    return float(s[target] / n - beta @ (s[pick] / n)), beta


@dataclass
class CorrelationImputer:
    """Predicts absent schema columns from the present ones; medians and modes otherwise."""

    industry: str
    alpha: float = 1.0
    feature_medians: dict[str, float] = field(default_factory=dict)
    categorical_modes: dict[str, str] = field(default_factory=dict)
    numeric: list[str] = field(default_factory=list)
    models: dict[str, tuple[float, dict[str, float]]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> CorrelationImputer:
        schema = [c for c in catalog.SCHEMAS[self.industry] if c in train.columns]
        self.numeric = [c for c in schema if catalog.ROLES[c] != "text"]
        texts = [c for c in schema if catalog.ROLES[c] == "text"]
        df = train.select(
            F.lit(1).alias("__all"), *[to_number(F.col(c)).alias(c) for c in self.numeric], *texts)
        self.feature_medians = {c: 0.0 for c in self.numeric}
        if self.numeric:
            for r in medians(df, self.numeric, ["__all"]).collect():
                self.feature_medians[r["column"]] = r["median"]
        self.categorical_modes = {c: str(catalog.DEFAULTS.get(c, "unknown")) for c in texts}
        if texts:
            for r in modes(df, texts, ["__all"]).collect():
                self.categorical_modes[r["column"]] = r["mode"]
        if len(self.numeric) - 1 >= MIN_PREDICTORS:
            g = gram_table(df, self.numeric, self.feature_medians).first()
            for t, name in enumerate(self.numeric):
                others = [i for i in range(len(self.numeric)) if i != t]
                b0, beta = solve_ridge(g.n, g.sums, g.gram, t, others, self.alpha)
                self.models[name] = (
                    b0 + self.feature_medians[name],
                    {self.numeric[i]: float(b) for i, b in zip(others, beta)},
                )
        return self

    def impute(self, available: Sequence[str], missing: Sequence[str]) -> tuple[dict[str, Column], dict[str, str]]:
        """(column expressions, provenance) for the missing features."""
        have = {c for c in available if catalog.ROLES.get(c) != "text"}
        values: dict[str, Column] = {}
        sources: dict[str, str] = {}
        for name in missing:
            model = self.models.get(name)
            if model is not None and len(have & model[1].keys()) >= MIN_PREDICTORS:
                intercept, beta = model
                # An absent predictor sits at its median, where it contributes nothing.
                out = F.lit(intercept)
                for c, b in beta.items():
                    if c in have:
                        m = F.lit(self.feature_medians[c])
                        out = out + F.lit(b) * (F.coalesce(to_number(F.col(c)), m) - m)
                out = F.greatest(out, F.lit(0.0))
                if catalog.ROLES[name] in ("discrete", "binary"):
                    out = F.rint(out).cast("int")
                values[name], sources[name] = out, "correlation"
            elif name in self.feature_medians:
                values[name], sources[name] = F.lit(self.feature_medians[name]), "training_median"
            elif name in self.categorical_modes:
                values[name], sources[name] = F.lit(self.categorical_modes[name]), "training_mode"
            else:
                values[name], sources[name] = F.lit(catalog.DEFAULTS.get(name, 0)), "static_default"
        return values, sources
