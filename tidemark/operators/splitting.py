"""Stratified splits and folds with exact sizes per label.

Rows are ordered within a label by a key hash.  Only the cut points are looked up, through
``order_statistics``; assigning a row to its part is then a projection, so the rows
themselves are never shuffled and a dominant label cannot overload a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import portable_hash
from tidemark.operators.selection import order_statistics


def hash_order(key: Column) -> Column:
    """The key hash as a double, which holds it exactly; keys of one hash fall into one part."""
    return portable_hash(key).cast("double")


def stratified_parts(df: DataFrame, key: str, label: str, cuts: Sequence[tuple[str, int, int]],
                     last: str, name: str = "part", **kw) -> DataFrame:
    """Assign each row to the first part whose cumulative share reaches its rank.

    ``cuts`` are ``(part, numerator, denominator)`` with cumulative shares; part sizes are
    ``ceil(n * numerator / denominator)`` cumulatively, and ``last`` takes the rest.
    """
    ranked = df.withColumn("__h", hash_order(F.col(key)))
    targets = {
        part: (num / den, lambda n, num=num, den=den: F.floor((n * num + (den - 1)) / den))
        for part, num, den in cuts
    }
    stats = order_statistics(ranked, ["__h"], [label], targets, **kw)
    marks = stats.groupBy(label).agg(*[
        F.max(F.when(F.col("target") == part, F.col("value"))).alias(f"__cut_{part}") for part, _, _ in cuts
    ])
    joined = ranked.join(F.broadcast(marks), label)
    out = F.lit(last)
    for part, _, _ in reversed(cuts):
        out = F.when(F.col("__h") <= F.col(f"__cut_{part}"), F.lit(part)).otherwise(out)
    return joined.withColumn(name, out).drop("__h", *[f"__cut_{p}" for p, _, _ in cuts])


def stratified_split(df: DataFrame, key: str, label: str, test_pct: int = 20, name: str = "part") -> DataFrame:
    return stratified_parts(df, key, label, [("test", test_pct, 100)], "train", name)


def stratified_split_3way(df: DataFrame, key: str, label: str, name: str = "part") -> DataFrame:
    return stratified_parts(df, key, label, [("train", 70, 100), ("val", 85, 100)], "test", name)


def kfold(df: DataFrame, key: str, label: str, k: int, name: str = "fold") -> DataFrame:
    """Stratified folds 0..k-1."""
    cuts = [(str(i), i + 1, k) for i in range(k - 1)]
    out = stratified_parts(df, key, label, cuts, str(k - 1), name)
    return out.withColumn(name, F.col(name).cast("int"))
