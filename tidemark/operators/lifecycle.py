"""Training, ingestion, augmentation and evaluation jobs on top of the operators."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars as S
from tidemark.operators import align, conformal, matcher, metrics, models, profile, serving, splitting
from tidemark.operators.store import Store, Version
from tidemark.session import materialize
from tidemark.sources import tables


def ingest(df: DataFrame, industry: str, key: str) -> DataFrame:
    """A labelled upload as cleaned rows with a 70/15/15 ``part``.

    The target is found first so that no feature can claim its column.
    """
    headers = [c for c in df.columns if c != key]
    target = next((h for h in headers if catalog.clean(h) in catalog.target_words()), None)
    if target is None:
        raise ValueError("could not detect a target churn column")
    mapping = matcher.map_columns(df.sparkSession, [h for h in headers if h != target], industry)
    labelled = df.withColumn("__label", S.map_target_values(F.col(f"`{target}`").cast("string"))).drop(target)
    cleaned = align.clean_features(
        align.rename_mapped(labelled, mapping).withColumnRenamed("__label", "churned"), industry, [key, "churned"])
    return splitting.stratified_split_3way(cleaned.dropna(subset=["churned"]), key, "churned")


def prepare_training(df: DataFrame, industry: str, key: str) -> tuple[DataFrame, list[str], list[str]]:
    """Validated rows with flag columns cast, and the classifier's feature lists."""
    align.require_valid_target(df)
    ready = align.validate(df.withColumn("__key", F.col(key)), industry).withColumnRenamed("__key", key)
    numeric, categorical = align.feature_types(ready.columns, industry)
    flags = [r["column"] for r in profile.binary_columns(
        ready, numeric + categorical, catalog.BINARY_LIKE_VALUES).where("is_binary").collect()]
    # A column without any value is left to imputation rather than turned into zeros.
    present = {r["column"] for r in profile.profile_columns(ready.select(*numeric, *categorical)).where(
        "non_null > 0").collect()}
    ready = align.cast_flags(ready, [c for c in flags if c in present])
    as_number = [c for c in categorical if c in flags and c in present]
    categorical = [c for c in categorical if c not in as_number]
    return ready, numeric + as_number, categorical


@dataclass
class TrainedIndustry:
    industry: str
    model: models.StackedModel
    quantiles: DataFrame
    coverage: DataFrame
    evaluation: DataFrame
    trials: list[dict]


def train_industry(industry: str, train: DataFrame, val: DataFrame, test: DataFrame, key: str,
                   trials: int = 3, folds: int = 5, space: dict | None = None, path: str | None = None) -> TrainedIndustry:
    """Tune, stack, calibrate on ``val``, check the guardrail, evaluate on ``test``, persist."""
    rows, numeric, categorical = prepare_training(train, industry, key)
    best, done = models.tune(rows, numeric, categorical, key, trials=trials, folds=min(3, folds), space=space)
    model = models.fit_stack(rows, numeric, categorical, key, folds=folds, params=best)
    return finish(industry, model, val, test, key, done, path)


def finish(industry, model, val, test, key, trials=(), path=None) -> TrainedIndustry:
    def scored(df: DataFrame, name: str) -> DataFrame:
        ready = align.validate(df.withColumn("__key", F.col(key)), industry).withColumnRenamed("__key", key)
        casts = {c: S.cast_training_flag(F.col(c)) for c in model.numeric
                 if catalog.ROLES[c] == "text" and c in ready.columns}
        return materialize(model.probabilities(ready.withColumns(casts)).select(
            key, "churned", "p", F.lit(industry).alias("industry")), name)

    calibration = scored(val, "calibration")
    quantiles = conformal.calibrate(calibration, ["industry"])
    cover = conformal.coverage(conformal.prediction_sets(calibration, quantiles, ["industry"]), ["industry"])
    conformal.require_guardrail(cover)
    evaluation = metrics.evaluate(scored(test, "evaluation"))
    if path is not None:
        model.save(f"{path}/model")
        quantiles.write.mode("overwrite").parquet(f"{path}/quantiles")
    return TrainedIndustry(industry, model, quantiles, cover, evaluation, list(trials))


def train_all(industries: Sequence[str], train_one: Callable[[str], TrainedIndustry]) -> tuple[dict, dict[str, str]]:
    """Train every industry; a failure is recorded with its traceback and does not stop the others."""
    done, failed = {}, {}
    for industry in industries:
        try:
            done[industry] = train_one(industry)
        except Exception:  # noqa: BLE001
            failed[industry] = traceback.format_exc()
    return done, failed


def route_upload(df: DataFrame, filename: str, key: str, label: str = "churned") -> DataFrame:
    """Labelled rows with ``part`` = train or val, as the file name asks.

    Rows with an unknown label are dropped.  Other files split 80/20, stratified.
    """
    valid = align.valid_targets(df, label)
    name = filename.lower()
    if "train" in name:
        return valid.withColumn("part", F.lit("train"))
    if any(w in name for w in ("val", "calib")):
        return valid.withColumn("part", F.lit("val"))
    return splitting.stratified_split(valid, key, label).withColumn(
        "part", F.when(F.col("part") == "test", "val").otherwise("train"))


def augment(base: str, upload: DataFrame, filename: str, industry: str, key: str,
            refit: Callable[[DataFrame, DataFrame], TrainedIndustry]) -> tuple[dict, TrainedIndustry]:
    """Extend a plain training table and refit; nothing is appended unless the refit passes.

    ``base`` holds the table partitioned by ``part``.  The guardrail runs inside ``refit`` on base plus increment, and
    only then is the increment appended.  ``augment_store`` also publishes rows, model and serving tables at once.
    """
    spark = upload.sparkSession
    rows = materialize(route_upload(upload, filename, key), "increment")
    current = spark.read.parquet(base)
    merged = tables.augmented(current, rows)
    trained = refit(merged.where("part = 'train'").drop("part"), merged.where("part = 'val'").drop("part"))
    rows.select(*[c for c in current.columns if c in rows.columns]).write.mode("append").partitionBy("part").parquet(base)
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"industry": industry, "train_records_added": counts.get("train", 0),
            "val_records_added": counts.get("val", 0)}, trained


@dataclass
class Refitted:
    """A model refitted on a table's rows, how it covers the calibration rows, and these rows as it has scored them."""

    model: models.StackedModel
    coverage: DataFrame
    scored: DataFrame


def refit(industry: str, train: DataFrame, val: DataFrame, key: str, folds: int = 5, params: dict | None = None,
          tolerance: float = catalog.GUARDRAIL) -> Refitted:
    """Refit the stack on cleaned ``train`` rows and recalibrate on ``val``; raises where the guardrail is breached."""
    numeric, categorical = align.feature_types(train.columns, industry)
    model = models.fit_stack(train, numeric, categorical, key, folds=folds, params=params)
    scored = materialize(model.probabilities(val).select("churned", "p", F.lit(industry).alias("industry")), "calibration")
    sets = conformal.prediction_sets(scored, conformal.calibrate(scored, ["industry"]), ["industry"])
    cover = materialize(conformal.coverage(sets, ["industry"]), "coverage")
    conformal.require_guardrail(cover, tolerance)
    return Refitted(model, cover, scored)


def training_rows(store: Store, version: Version) -> DataFrame:
    """All rows (with ``part``) that a version was fitted on: those of its first upload and of each increment."""
    rows = None
    for path in version.meta["rows"]:
        own = store.spark.read.parquet(path)
        rows = own if rows is None else tables.augmented(rows, own)
    return rows


def augment_store(store: Store, upload: DataFrame, filename: str, industry: str, key: str, batch: str,
            features: Sequence[str] | None = None, **how) -> tuple[dict, Version]:
    """Extend an industry's training rows by a labelled upload, refit, recalibrate, and publish all of it or nothing.

    The increment, the model and the serving tables are written into a folder that nothing names yet; only a refit
    that passes the guardrail is published, with the list of row folders, in one manifest.  A rejected or interrupted
    upload leaves no trace, a ``batch`` published before is answered from its version and changes nothing, and
    ``Store.rollback`` brings an earlier version back.  The first upload of an empty store starts the table.

    ``upload`` has ``key``, ``churned`` and columns of the schema; rows without a known label are dropped.  The file's
    name decides whether rows train, calibrate or are split.  ``how`` goes to ``refit``.
    """
    if (done := store.of_batch(batch)) is not None:
        return done.meta["counts"], done
    before, folder = store.current(), store.stage()
    routed = route_upload(upload, filename, key)
    align.clean_features(routed, industry, [key, "churned", "part"]).write.parquet(f"{folder}/rows")
    rows = store.spark.read.parquet(f"{folder}/rows")
    merged = rows if before is None else tables.augmented(training_rows(store, before), rows)
    train, val = (merged.where(F.col("part") == p).drop("part") for p in ("train", "val"))
    fitted = refit(industry, train, val, key, **how)
    state = serving.fit_state(industry, train, val, fitted.model, features, key, scored=fitted.scored)
    n = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {"industry": industry, "train_records_added": n.get("train", 0), "val_records_added": n.get("val", 0)}
    paths = [*(before.meta["rows"] if before else []), f"{folder}/rows"]
    return counts, serving.publish_state(store, state, batch, before, {"rows": paths, "counts": counts}, folder)
