"""Exploratory aggregates over arbitrary tables, each in one pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import stable_round


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def industry_kpis(df: DataFrame, by: Sequence[str] = ("industry",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_customers"),
        stable_round(F.avg("churned") * 100, 2).alias("churn_rate"),
        stable_round(F.avg("monthly_spend_usd"), 2).alias("avg_monthly"),
        stable_round(F.avg("tenure_months"), 1).alias("avg_tenure"),
    )


def target_distribution(df: DataFrame, by: Sequence[str], label: str = "churned") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("retained"),
        F.count(F.when(F.col(label) == 1, 1)).alias("churned"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and share of all rows; the window only spans the distinct values' total."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    # One-row side: the grand total.
    joined = counts.withColumn("__one", F.lit(1)).join(
        F.broadcast(total.withColumn("__one", F.lit(1))), "__one")
    return joined.select("value", "n", stable_round(F.col("n") * 100 / F.col("total"), 2).alias("pct"))


def stacked(df: DataFrame, columns: Sequence[str], aggregates: dict[str, callable]) -> DataFrame:
    """One aggregation row per column: ``(column, *aggregates)`` from a single pass."""
    row = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), *[fn(F.col(c)).alias(n) for n, fn in aggregates.items()])
        for c in columns
    ]).alias("cols"))
    return row.select(F.inline("cols"))


def profile_columns(df: DataFrame) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = stacked(df, df.columns, {
        "rows": lambda c: F.count(F.lit(1)),
        "non_null": lambda c: F.count(c),
    })
    names = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return out.select("column", names[F.col("column")].alias("dtype"), "rows", "non_null")


def null_blank_counts(df: DataFrame) -> DataFrame:
    return stacked(df, df.columns, {
        "nulls": lambda c: F.count(F.when(c.isNull(), 1)),
        "blanks": lambda c: F.count(F.when(F.trim(c.cast("string")) == "", 1)),
    })


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations over pairwise complete rows, upper triangle in long form."""
    row = df.agg(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                 F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
        for a, b in combinations_with_replacement(columns, 2)
    ]).alias("cols"))
    return row.select(F.inline("cols"))


def category_label_counts(df: DataFrame, category: str, label: str = "churned", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(category).alias("category")).agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("retained"),
        F.count(F.when(F.col(label) == 1, 1)).alias("churned"),
        stable_round(F.avg(label) * 100, 2).alias("churn_rate"),
    )


def class_histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int,
                    label: str = "churned") -> DataFrame:
    """Share of each class per bin; bins 0 and bins+1 hold the outliers."""
    binned = df.where(F.col(column).isNotNull()).groupBy(
        label, F.width_bucket(F.col(column).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin"))
    counts = binned.agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(label))
    return counts.select(label, "bin", "n", stable_round(share, 6).alias("share"))


def class_density(df: DataFrame, column: str, grid: Sequence[float], width: float,
                  label: str = "churned") -> DataFrame:
    """Gaussian kernel density per class on a fixed grid, each class normalised on its own.

    Rows are first counted per bin of ``width`` (exact for whole numbers and width 1), so the
    kernel runs over bins x grid points whatever the number of rows.  The bandwidth follows
    Scott's rule.
    """
    x = F.col(column).cast("double")
    present = df.where(x.isNotNull())
    stats = present.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sd"))
    bins = present.groupBy(label, (F.floor(x / width) * width).alias("center")).agg(F.count(F.lit(1)).alias("c"))
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    spread = bins.join(F.broadcast(stats), label).select("*", points.alias("x"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    u = (F.col("x") - F.col("center")) / h
    mass = F.sum(F.col("c") * F.exp(F.lit(-0.5) * u * u) / (F.col("n") * h * F.lit(2.5066282746310002)))
    return spread.groupBy(label, "x").agg(stable_round(mass, 8).alias("density"))


def zero_variance_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns whose sample variance is zero."""
    out = stacked(df, columns, {"variance": lambda c: F.var_samp(c.cast("double"))})
    return out.select("column", (F.col("variance") == 0).alias("zero_variance"))


def binary_columns(df: DataFrame, columns: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Columns with at most two distinct values, all of them flag-like.

    A column with more than two distinct values is recognised from its smallest and largest
    value plus whether any third value exists, so no value set is ever collected.
    """
    ends = df.agg(*[F.struct(F.min(F.col(c).cast("string")).alias("lo"),
                             F.max(F.col(c).cast("string")).alias("hi")).alias(c) for c in columns])
    tagged = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).withColumn("__one", F.lit(1))
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in columns]).withColumn("__one", F.lit(1))
    joined = tagged.join(F.broadcast(ends), "__one")
    row = joined.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.max((~F.col(c).isin(*words)).cast("int")), F.lit(0)).alias("other_words"),
            F.coalesce(F.max(((F.col(c) != F.col(f"__{c}.lo")) & (F.col(c) != F.col(f"__{c}.hi"))).cast("int")),
                       F.lit(0)).alias("third_value"),
        ) for c in columns
    ]).alias("cols"))
    return row.select(F.inline("cols")).select(
        "column", ((F.col("other_words") == 0) & (F.col("third_value") == 0)).alias("is_binary"))
