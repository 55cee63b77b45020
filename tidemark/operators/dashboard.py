"""Dashboard statistics from states that batches add to.

Two tables hold everything: sums of an industry's customers, and how many rows of a split have a probability (to six
decimals) and a label.  Both are sums, so the state of two batches together is the sum of theirs, and the second has at
most two million rows an industry and split, however many customers there are.  Accuracy, AUC, Brier score,
conformal quantiles, coverage, sets and confident rates are all functions of it, exactly as over the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import stable_round
from tidemark.operators import conformal as CF
from tidemark.operators import metrics as M
from tidemark.operators.selection import running_total
from tidemark.session import pin

SUMS = ("customers", "labelled", "churned", "spend", "spend_n", "tenure", "tenure_n")


def sums_of(rows: DataFrame) -> DataFrame:
    """(industry, sums): what customers add to their industry."""
    spend, tenure, y = F.col("monthly_spend_usd").cast("double"), F.col("tenure_months").cast("double"), F.col("churned")
    return rows.groupBy("industry").agg(
        F.count(F.lit(1)).alias("customers"), F.count(y).alias("labelled"), F.coalesce(F.sum(y), F.lit(0)).cast("bigint").alias("churned"),
        F.coalesce(F.sum(spend), F.lit(0.0)).alias("spend"), F.count(spend).alias("spend_n"),
        F.coalesce(F.sum(tenure), F.lit(0.0)).alias("tenure"), F.count(tenure).alias("tenure_n"))


def counts_of(scored: DataFrame) -> DataFrame:
    """(industry, split, p, churned, n): what scored rows (industry, split, p, churned) add to the counts."""
    return scored.groupBy("industry", "split", stable_round(F.col("p"), 6).alias("p"), "churned").agg(F.count(F.lit(1)).alias("n"))


def append(path: str, batch: str, rows: DataFrame, scored: DataFrame) -> None:
    """Add a batch to the state below ``path``; the same batch again replaces what it added."""
    sums_of(rows).write.mode("overwrite").parquet(f"{path}/sums/batch={batch}")
    counts_of(scored).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")


def state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sums, counts) of all batches together."""
    sums = spark.read.parquet(f"{path}/sums").groupBy("industry").agg(*[F.sum(c).alias(c) for c in SUMS])
    counts = spark.read.parquet(f"{path}/counts").groupBy("industry", "split", "p", "churned").agg(F.sum("n").alias("n"))
    return sums, pin(counts)


def quantiles(counts: DataFrame) -> DataFrame:
    """(industry, level_pct, qhat) of the calibration rows: the first score that enough rows reach."""
    s = CF.nonconformity(F.col("p"), F.col("churned"))
    scores = counts.where(F.col("split") == "val").groupBy("industry", s.alias("s")).agg(F.sum("n").alias("n"))
    below = running_total(scores, ["industry"], "s", "n", "below")
    total = scores.groupBy("industry").agg(F.sum("n").alias("total"))
    levels = F.explode(F.array(*map(F.lit, catalog.LEVELS_PCT)))
    each = below.join(total, "industry").withColumn("level_pct", levels)
    wanted = F.floor(((F.col("total") + 1) * F.col("level_pct") + 99) / 100)
    reached = F.col("below") + F.col("n") >= wanted
    return each.groupBy("industry", "level_pct").agg(F.coalesce(F.min(F.when(reached, F.col("s"))), F.lit(1.0)).alias("qhat"))


def _share(part: Column) -> Column:
    return F.sum(F.when(part, F.col("n")).otherwise(0)) / F.sum("n")


def quality(counts: DataFrame) -> DataFrame:
    """(industry, accuracy_pct, brier_score, calibration_score, auc_pct) of the test rows."""
    test = counts.where(F.col("split") == "test")
    hit = M.predicted(F.col("p")) == F.col("churned")
    brier = F.sum(F.pow(F.col("p") - F.col("churned"), 2) * F.col("n")) / F.sum("n")
    plain = test.groupBy("industry").agg(_share(hit).alias("accuracy"), brier.alias("brier"))
    pos, neg = (F.sum(F.when(F.col("churned") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    ties = test.groupBy("industry", "p").agg(pos.alias("pos"), neg.alias("neg"))
    ranked = running_total(ties, ["industry"], "p", "neg", "below")
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    auc = ranked.groupBy("industry").agg(
        F.when(pairs > 0, F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5)) / pairs).alias("auc"))
    return plain.join(auc, "industry").select(
        "industry", stable_round(F.col("accuracy") * 100, 2).alias("accuracy_pct"), stable_round(F.col("brier"), 4).alias("brier_score"),
        stable_round((1 - F.col("brier")) * 100, 1).alias("calibration_score"), stable_round(F.col("auc") * 100, 2).alias("auc_pct"))


def levels(counts: DataFrame) -> DataFrame:
    """(industry, level_pct, coverage, avg_set_size, retained, churned, uncertain, costs, confident_rate_train, confident_rate_val)."""
    in0, in1 = CF.in_set(F.col("p"), F.col("qhat"))
    sets = counts.join(quantiles(counts), "industry").withColumns({"in0": in0, "in1": in1})
    one = F.col("in0") != F.col("in1")
    own = F.when(F.col("churned") == 1, F.col("in1")).otherwise(F.col("in0"))
    size = F.col("in0").cast("int") + F.col("in1").cast("int")
    n = F.col("n")
    count = lambda c: F.sum(F.when(c, n).otherwise(0))
    by = ["industry", "level_pct"]
    test = sets.where(F.col("split") == "test").groupBy(*by).agg(
        stable_round(_share(own) * 100, 2).alias("coverage"), stable_round(F.sum(size * n) / F.sum("n"), 4).alias("avg_set_size"),
        count(F.col("in0") & ~F.col("in1")).alias("retained"), count(F.col("in1") & ~F.col("in0")).alias("churned"),
        count(~one).alias("uncertain"))
    sure = sets.where(F.col("split").isin("train", "val")).groupBy(*by).agg(*[
        stable_round(F.sum(F.when(one & (F.col("split") == s), n).otherwise(0)) * 100 / F.sum(F.when(F.col("split") == s, n)), 2)
        .alias(f"confident_rate_{s}") for s in ("train", "val")])
    return CF.business_impact(test).join(sure, by, "left")


def assemble(sums: DataFrame, counts: DataFrame, importances: DataFrame | None = None, learners: DataFrame | None = None,
             files: DataFrame | None = None) -> DataFrame:
    """One row per industry: its customers, model quality and four levels; with each further table given, its rows as a list.

    ``importances`` (industry, feature, importance), ``learners`` (industry, learner, accuracy_pct) and ``files``
    (industry, name, kind, rows, size_kb) hold a few rows an industry; of the importances the ten largest are shown.
    """
    head = sums.select(
        "industry", F.col("customers").alias("total_customers"), stable_round(F.col("churned") / F.col("labelled") * 100, 2).alias("churn_rate"),
        stable_round(F.col("spend") / F.col("spend_n"), 2).alias("avg_monthly"), stable_round(F.col("tenure") / F.col("tenure_n"), 1).alias("avg_tenure"),
        (F.col("labelled") - F.col("churned")).alias("retained_customers"), F.col("churned").alias("churned_customers"))
    per_level = levels(counts)
    shown = [c for c in per_level.columns if c not in ("industry",)]
    out = head.join(quality(counts), "industry", "left").join(
        per_level.groupBy("industry").agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("levels")), "industry", "left")
    if importances is not None:
        largest = F.slice(F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False), 1, 10)
        out = out.join(importances.groupBy("industry").agg(largest.alias("importances")), "industry", "left")
    for name, extra in (("learners", learners), ("files", files)):
        if extra is not None:
            fields = [c for c in extra.columns if c != "industry"]
            out = out.join(extra.groupBy("industry").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name)), "industry", "left")
    return out
