"""Exact order statistics, ordinals and running totals without a global sort.

No step puts a whole group into one task: a bounded sketch brackets the wanted rank, and
only the few distinct values inside the bracket are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.feature import Bucketizer

# target name -> (fraction where the rank lies for large n, rank as a function of n)
Targets = Mapping[str, tuple[float, Callable[[Column], Column]]]

SMALL_GROUP = 50_000
SKETCH_ACCURACY = 50_000


def order_statistics(df: DataFrame, columns: Sequence[str], by: Sequence[str], targets: Targets,
                     small: int = SMALL_GROUP, accuracy: int = SKETCH_ACCURACY,
                     bounded_groups: bool = True) -> DataFrame:
    """The exact k-th smallest non-null value per group, column and target.

    Returns ``(*by, column, n, target, value)``; the value is NULL when the rank is outside
    1..n.  Groups of up to ``small`` values are ranked whole.  For larger ones a quantile
    sketch of relative rank error 1/accuracy gives a bracket of about ``4n/accuracy`` values
    around each rank; values below it are only counted.

    ``bounded_groups`` states that the groups come from a fixed vocabulary (industries,
    splits, labels), so the bracket table is tiny and may be broadcast.
    """
    by = list(by)
    delta = 2.0 / accuracy
    numeric = df.selectExpr(*by, *[f"TRY_CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns])
    marks = sorted({max(0.0, f - delta) for f, _ in targets.values()}
                   | {min(1.0, f + delta) for f, _ in targets.values()})
    sketched = numeric.groupBy(*by).agg(F.expr("array(" + ", ".join(
        f"struct('{c}' AS column, count(`{c}`) AS n, percentile_approx(`{c}`, array({', '.join(map(_double, marks))}), "
        f"{accuracy}) AS sketch)" for c in columns) + ")").alias("cols"))

    def slot(name: str, fraction: float, rank: Callable[[Column], Column]) -> Column:
        large = F.col("n") > small
        lo, hi = marks.index(max(0.0, fraction - delta)), marks.index(min(1.0, fraction + delta))
        return F.struct(
            F.lit(name).alias("target"), rank(F.col("n")).cast("bigint").alias("rank"),
            F.when(large, F.col("sketch")[lo]).alias("lo"), F.when(large, F.col("sketch")[hi]).alias("hi"))

    brackets = sketched.select(*by, F.inline("cols")).select(
        *by, "column", "n", F.array(*[slot(name, f, rank) for name, (f, rank) in targets.items()]).alias("slots"))
    side = F.broadcast(brackets) if bounded_groups else brackets
    long = numeric.unpivot(by, list(columns), "column", "value").where(F.col("value").isNotNull())
    keys = [*by, "column"]
    inside = (
        _null_safe_join(long, side, keys)
        .select(*keys, "value", "n", F.inline("slots"))
        .where(F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
        .withColumn("value", F.when(F.col("lo").isNull() | (F.col("value") >= F.col("lo")), F.col("value")))
    )
    counted = inside.groupBy(*keys, "n", "target", "rank", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys, "target").orderBy(F.col("value").asc_nulls_first())
    running = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = running.groupBy(*keys, "n", "target", "rank").agg(
        F.min(F.when((F.col("upto") >= F.col("rank")) & (F.col("rank") >= 1), F.col("value"))).alias("value"))
    # a bracket is twice as wide as the sketch may err; should one miss its rank all the same, that must not pass for NULL
    missed = F.when(F.col("rank").between(1, F.col("n")), F.raise_error(F.lit("a bracket has missed its rank")).cast("double"))
    return found.select(*keys, "n", "target", F.coalesce("value", missed).alias("value"))


def _double(x: float) -> str:
    return f"{x!r}D"


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = right.select([F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__{k}"]) for k in keys])
    return left.join(r, cond).drop(*[f"__{k}" for k in keys])


MEDIAN: Targets = {
    "lower": (0.5, lambda n: F.floor((n + 1) / 2)),
    "upper": (0.5, lambda n: F.floor((n + 2) / 2)),
}


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """Exact interpolated medians, long form ``(*by, column, n, median)``, NULLs skipped."""
    stats = order_statistics(df, columns, by, MEDIAN, **kw)
    return stats.groupBy(*by, "column", "n").agg(F.avg("value").alias("median"))


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, smallest on ties, long form ``(*by, column, n, mode)``."""
    by = list(by)
    long = (
        df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot(by, list(columns), "column", "value").where(F.col("value").isNotNull())
    )
    counts = long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*by, "column").agg(
        F.sum("c").alias("n"),
        F.min_by("value", F.struct(-F.col("c"), F.col("value"))).alias("mode"),
    )


#: Rows of a key range that ``ordinal`` numbers in one task, about.
RANGE_ROWS = 1_000_000


def ordinal(df: DataFrame, key: str, name: str = "ordinal", buckets: int | None = None) -> DataFrame:
    """Number the rows 1..n by a unique numeric key.

    Equi-depth key ranges from a sketch are numbered independently and shifted by the
    counts of the ranges before them, so no task sorts more than its range; there are as many ranges as the rows
    need, 256 at least.
    """
    buckets = buckets or max(256, -(-df.count() // RANGE_ROWS))
    marks = [i / buckets for i in range(1, buckets)]
    row = df.select(F.percentile_approx(F.col(key).cast("double"), marks, 10_000).alias("q")).first()
    cuts = sorted({float(v) for v in (row.q or [])})
    splits = [float("-inf"), *cuts, float("inf")]
    tagged = Bucketizer(splits=splits, inputCol="__k", outputCol="__b").transform(
        df.withColumn("__k", F.col(key).cast("double"))
    )
    counts = tagged.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    local = tagged.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(key)))
    return (
        local.join(F.broadcast(offsets), "__b")
        .withColumn(name, F.col("__r") + F.col("__o"))
        .drop("__b", "__k", "__n", "__o", "__r")
    )


def running_total(df: DataFrame, by: Sequence[str], order: str, amount: str, name: str,
                  fanout: int = 4096) -> DataFrame:
    """Sum of ``amount`` over rows of the group with a smaller ``order`` value in [0, 1].

    ``(*by, order)`` must be unique.  Totals of coarse and fine value ranges are accumulated
    first, so the last window only spans one fine range.
    """
    by = list(by)
    tagged = df.withColumn("__c", F.floor(F.col(order) * fanout)).withColumn(
        "__f", F.floor(F.col(order) * fanout * fanout))
    fine = tagged.groupBy(*by, "__c", "__f").agg(F.sum(amount).alias("__s"))
    coarse = fine.groupBy(*by, "__c").agg(F.sum("__s").alias("__s"))

    def before(keys: Sequence[str], col: str) -> Window:
        return Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)

    def total(src: str, w: Window) -> Column:
        return F.coalesce(F.sum(src).over(w), F.lit(0))

    coarse = coarse.select(*by, "__c", total("__s", before(by, "__c")).alias("__oc"))
    fine = fine.select(*by, "__c", "__f", total("__s", before([*by, "__c"], "__f")).alias("__of"))
    offsets = fine.join(coarse, [*by, "__c"]).select(*by, "__f", (F.col("__oc") + F.col("__of")).alias("__o"))
    within = total(amount, before([*by, "__f"], order))
    return (
        tagged.withColumn("__w", within).join(offsets, [*by, "__f"])
        .withColumn(name, F.col("__w") + F.col("__o"))
        .drop("__c", "__f", "__w", "__o")
    )
