"""Impute, scale and encode: fitting is one aggregate, applying is one projection."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import to_number
from tidemark.operators.selection import medians, modes

MAX_LEVELS = 10_000


def scaling_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str], **kw) -> DataFrame:
    """(*by, column, median, mean, sd) of the median-imputed columns.

    Mean and population deviation after imputation follow from the moments of the present
    values, so imputing first needs no second pass over the rows.  A constant column gets
    deviation 1.
    """
    by = list(by)
    med = medians(df, columns, by, **kw).select(*by, "column", "median")
    moments = df.groupBy(*by).agg(F.expr("array(" + ", ".join(
        f"struct('{c}' AS column, CAST(count(1) AS DOUBLE) AS n, CAST(count(TRY_CAST(`{c}` AS DOUBLE)) AS DOUBLE) AS n1, "
        f"coalesce(avg(TRY_CAST(`{c}` AS DOUBLE)), 0D) AS m1, coalesce(var_pop(TRY_CAST(`{c}` AS DOUBLE)), 0D) AS v1)"
        for c in columns) + ")").alias("cols")).select(*by, F.inline("cols"))
    joined = moments.join(med, [*by, "column"], "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    n0 = F.col("n") - F.col("n1")
    mean = (F.col("n1") * F.col("m1") + n0 * F.col("median")) / F.col("n")
    var = (
        F.col("n1") * (F.col("v1") + F.pow(F.col("m1") - F.col("mean"), 2))
        + n0 * F.pow(F.col("median") - F.col("mean"), 2)
    ) / F.col("n")
    return (
        joined.withColumn("mean", mean).withColumn("sd", F.sqrt(var))
        .withColumn("sd", F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd")))
        .select(*by, "column", "median", "mean", "sd")
    )


def widen(stats: DataFrame, by: Sequence[str], columns: Sequence[str], value: str) -> DataFrame:
    """Long statistics to one row per group with a struct per column."""
    return stats.groupBy(*by).agg(*[
        F.max(F.when(F.col("column") == c, F.col(value))).alias(f"__{value}_{c}") for c in columns
    ])


def standard_scale(df: DataFrame, stats: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Median-impute and standardise ``columns`` with their group's statistics.

    The statistics hold one row per group of a fixed vocabulary and are broadcast.
    """
    wide = stats.groupBy(*by).agg(*[
        F.expr(f"max(CASE WHEN column = '{c}' THEN struct(median, mean, sd) END) AS `__{c}`") for c in columns
    ])
    joined = df.join(F.broadcast(wide), list(by))
    return joined.withColumns({
        c: F.expr(f"(coalesce(TRY_CAST(`{c}` AS DOUBLE), `__{c}`.median) - `__{c}`.mean) / `__{c}`.sd") for c in columns
    }).drop(*[f"__{c}" for c in columns])


def impute_median_mode(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                       by: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Fill numeric columns with the group's median and text columns with its mode."""
    source = df if train is None else train
    by = list(by)
    fill = widen(medians(source, numeric, by), by, numeric, "median")
    tops = widen(modes(source, categorical, by), by, categorical, "mode")
    joined = df.join(F.broadcast(fill), by, "left").join(F.broadcast(tops), by, "left")
    return joined.withColumns({
        **{c: F.coalesce(to_number(F.col(c)), F.col(f"__median_{c}"), F.lit(0.0)) for c in numeric},
        **{c: F.coalesce(F.col(c), F.col(f"__mode_{c}")) for c in categorical},
    }).drop(*[f"__median_{c}" for c in numeric], *[f"__mode_{c}" for c in categorical])


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column; refuses columns that are not categorical in size."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value").where(F.col("value").isNotNull())
    rows = long.distinct().limit(MAX_LEVELS * len(columns) + 1).collect()
    if len(rows) > MAX_LEVELS * len(columns):
        raise ValueError(f"more than {MAX_LEVELS} levels per column: {list(columns)}")
    out = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = False) -> DataFrame:
    """Indicator columns ``<column>_<value>``; unseen values give all zeros."""
    hot = {
        f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0))
        for c, values in levels.items() for v in (values[1:] if drop_first else values)
    }
    return df.withColumns(hot).drop(*levels)


# ---------------------------------------------------------------------------
# The same steps as Spark ML stages
# ---------------------------------------------------------------------------
class _ColumnParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "text columns", TypeConverters.toListString)


class TypeCaster(Transformer, _ColumnParams, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric columns to double (bad values to NULL), categorical columns to text."""

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        present = set(dataset.columns)
        casts: dict[str, Column] = {}
        for c in self.getOrDefault(self.numericCols):
            if c in present:
                casts[c] = to_number(F.col(c))
        for c in self.getOrDefault(self.categoricalCols):
            if c in present:
                casts[c] = F.col(c).cast("string")
        return dataset.withColumns(casts)


class Preprocessor(Estimator, _ColumnParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median-impute and standardise numeric columns, mode-impute categorical ones."""

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PreprocessorModel:
        num, cat = self.getOrDefault(self.numericCols), self.getOrDefault(self.categoricalCols)
        df = TypeCaster(numericCols=num, categoricalCols=cat).transform(dataset).withColumn("__all", F.lit(1))
        stats = {}
        if num:
            stats = {r["column"]: [r["median"], r["mean"], r["sd"]]
                     for r in scaling_stats(df, num, ["__all"]).collect()}
        tops = {r["column"]: r["mode"] for r in modes(df, cat, ["__all"]).collect()} if cat else {}
        return PreprocessorModel(numericCols=num, categoricalCols=cat, state=json.dumps({"num": stats, "cat": tops}))


class PreprocessorModel(Model, _ColumnParams, DefaultParamsReadable, DefaultParamsWritable):
    """Applies fitted imputation and scaling as one projection."""

    state = Param(Params._dummy(), "state", "fitted statistics as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, state=None):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], state="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault(self.state))
        dataset = TypeCaster(numericCols=self.getOrDefault(self.numericCols),
                             categoricalCols=self.getOrDefault(self.categoricalCols)).transform(dataset)
        cols: dict[str, Column] = {}
        for c in self.getOrDefault(self.numericCols):
            median, mean, sd = state["num"].get(c, [0.0, 0.0, 1.0])
            cols[c] = (F.coalesce(F.col(c), F.lit(median)) - F.lit(mean)) / F.lit(sd)
        for c in self.getOrDefault(self.categoricalCols):
            cols[c] = F.coalesce(F.col(c), F.lit(state["cat"].get(c, "missing")))
        return dataset.withColumns(cols)
