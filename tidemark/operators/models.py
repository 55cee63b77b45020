"""Churn classifiers: three tree ensembles, their stack, tuning and the proxy model."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import to_number
from tidemark.operators import metrics
from tidemark.operators.preprocess import Preprocessor
from tidemark.operators.splitting import kfold, stratified_split
from tidemark.operators.target_stats import OrderedLearner
from tidemark.session import for_passes, materialize

# Settings used when a model is refitted on augmented data, and each learner's search space.
REFIT = {"maxIter": 50, "maxDepth": 4, "stepSize": 0.08, "subsamplingRate": 0.8, "numTrees": 50}
_ROUNDS, _DEPTH = [50, 100, 150], [3, 4, 5, 6]
_STEP, _SHARE = [0.05, 0.10, 0.15, 0.20], [0.7, 0.8, 0.9, 1.0]
SEARCH_SPACE = {
    "gbt": {"maxIter": _ROUNDS, "maxDepth": _DEPTH, "stepSize": _STEP, "subsamplingRate": _SHARE, "featureShare": _SHARE},
    "rf": {"numTrees": _ROUNDS, "maxDepth": _DEPTH, "subsamplingRate": _SHARE, "featureShare": _SHARE},
    "encoded": {"maxIter": _ROUNDS, "maxDepth": _DEPTH, "stepSize": _STEP, "subsamplingRate": _SHARE},
}
LEARNERS = ("gbt", "rf", "encoded")
SEED = 42
#: Fits at a time, where each has rows for all cores.
FITS = 4


def _named(classifier, name: str):
    """Give every learner its own columns, so several can run in one pass."""
    return (classifier.setFeaturesCol(f"__vec_{name}").setPredictionCol(f"__pred_{name}")
            .setProbabilityCol(f"__prob_{name}").setRawPredictionCol(f"__raw_{name}"))


def bins_for(df: DataFrame, categorical: Sequence[str]) -> int:
    """Bins that native categories of the rows need: the largest number of levels, unseen ones and a margin."""
    if not categorical:
        return 0
    row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in categorical]).first()
    return int(max(row) * 1.1) + 3


def learner(name: str, numeric: Sequence[str], categorical: Sequence[str], label: str, p: dict, key: str) -> Pipeline | OrderedLearner:
    """One base learner on preprocessed columns.

    ``gbt`` sees one-hot categories, ``rf`` native categorical splits, ``encoded`` ordered target statistics of
    rows with a unique ``key``.  Unseen categories are kept as their own level.
    """
    cat = list(categorical)
    index = [f"__ix_{name}_{c}" for c in cat]
    stages: list = []
    if cat and name != "encoded":
        stages.append(StringIndexer(inputCols=cat, outputCols=index, handleInvalid="keep"))
    inputs = list(numeric)
    if cat and name == "gbt":
        hot = [f"__hot_{name}_{c}" for c in cat]
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))
        inputs += hot
    elif name != "encoded":
        inputs += index
    stages.append(VectorAssembler(inputCols=inputs, outputCol=f"__vec_{name}"))
    depth = max(2, p["maxDepth"] - 1) if name == "encoded" else p["maxDepth"]
    common = dict(labelCol=label, maxDepth=depth, subsamplingRate=p["subsamplingRate"], seed=SEED)
    if p.get("featureShare", 1.0) < 1.0:
        common["featureSubsetStrategy"] = str(p["featureShare"])
    if name == "rf":
        trees = RandomForestClassifier(numTrees=p["numTrees"], maxBins=max(256, p.get("maxBins", 0)), **common)
    else:
        trees = GBTClassifier(maxIter=p["maxIter"], stepSize=p["stepSize"], maxBins=max(64, p.get("maxBins", 0)), **common)
    if name == "encoded":
        return OrderedLearner(_named(trees, name), numeric, cat, label, key, f"__enc_{name}_", f"__vec_{name}")
    stages.append(_named(trees, name))
    return Pipeline(stages=stages)


def add_probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Score rows and keep one column, ``p_<name>``."""
    keep = df.columns
    return model.transform(df).select(*keep, vector_to_array(F.col(f"__prob_{name}"))[1].alias(f"p_{name}"))


@dataclass
class StackedModel:
    """Preprocessing, base learners and the logistic combiner."""

    preprocessor: object
    base: dict[str, PipelineModel]
    meta: LogisticRegressionModel
    numeric: list[str]
    categorical: list[str]

    def probabilities(self, df: DataFrame, name: str = "p", keep_base: bool = False) -> DataFrame:
        """Add ``name`` (and ``p_<learner>`` on request); the input columns stay unscaled."""
        original = [c for c in self.numeric + self.categorical if c in df.columns]
        out = df.withColumns({f"__in_{c}": F.col(c) for c in original})
        out = self.preprocessor.transform(out)
        for learner_name, model in self.base.items():
            out = add_probability(model, out, learner_name)
        out = combine(self.meta, out, name)
        out = out.withColumns({c: F.col(f"__in_{c}") for c in original}).drop(*[f"__in_{c}" for c in original])
        return out if keep_base else out.drop(*[f"p_{n}" for n in self.base])

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return self.probabilities(df, name)

    def importances(self) -> list[tuple[str, float]]:
        """(feature, share) of the learner with native categories, summing to one."""
        values = self.base["rf"].stages[-1].featureImportances.toArray()
        total = float(values.sum())
        names = self.numeric + self.categorical
        return [(n, float(v) / total if total > 0 else 0.0) for n, v in zip(names, values)]

    def save(self, path: str) -> None:
        self.preprocessor.write().overwrite().save(f"{path}/preprocessor")
        for n, m in self.base.items():
            m.write().overwrite().save(f"{path}/{n}")
        self.meta.write().overwrite().save(f"{path}/meta")

    @staticmethod
    def load(path: str) -> StackedModel:
        from tidemark.operators.preprocess import PreprocessorModel
        pre = PreprocessorModel.load(f"{path}/preprocessor")
        base = {n: PipelineModel.load(f"{path}/{n}") for n in LEARNERS}
        return StackedModel(pre, base, LogisticRegressionModel.load(f"{path}/meta"),
                            pre.getOrDefault(pre.numericCols), pre.getOrDefault(pre.categoricalCols))


def combine(meta: LogisticRegressionModel, df: DataFrame, name: str) -> DataFrame:
    keep = df.columns
    vec = VectorAssembler(inputCols=[f"p_{n}" for n in LEARNERS], outputCol="__meta")
    return meta.transform(vec.transform(df)).select(*keep, vector_to_array(F.col("__prob_meta"))[1].alias(name))


def _parallel(tasks: Sequence[Callable], threads: int) -> list:
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(lambda t: t(), [inheritable_thread_target(t) for t in tasks]))


def fits_at_once(rows: DataFrame) -> int:
    """How many fits run side by side: enough for all cores where the rows of one are in fewer partitions."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(FITS, -(-2 * cores // max(1, rows.rdd.getNumPartitions())))


def settings(params: dict | None, name: str) -> dict:
    """One learner's settings: the refit's, then those given to all, then its own."""
    params = params or {}
    shared = {k: v for k, v in params.items() if k not in LEARNERS}
    return {**REFIT, **shared, **params.get(name, {})}


@dataclass
class Prepared:
    """Rows preprocessed once, with folds, as any number of fits read them."""

    preprocessor: object
    rows: DataFrame
    numeric: list[str]
    categorical: list[str]
    key: str
    label: str
    folds: int
    bins: int
    threads: int


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], key: str, label: str = "churned", folds: int = 5) -> Prepared:
    num, cat = list(numeric), list(categorical)
    rows = df.select(key, F.col(label).cast("double").alias(label), *num, *cat)
    pre = Preprocessor(numericCols=num, categoricalCols=cat).fit(rows)
    ready = materialize(for_passes(kfold(pre.transform(rows), key, label, folds), rows.count()), "stack-rows")
    return Prepared(pre, ready, num, cat, key, label, folds, bins_for(ready, cat), fits_at_once(ready))


def fit_prepared(own: Prepared, params: dict | None = None, threads: int | None = None) -> StackedModel:
    """Out-of-fold base probabilities train the combiner; base learners are refitted on all rows."""
    threads = threads or own.threads
    num, cat, key, label, folds, ready = own.numeric, own.categorical, own.key, own.label, own.folds, own.rows

    def fit(name: str, part: DataFrame) -> Callable:
        p = {"maxBins": own.bins, **settings(params, name)}
        return lambda: learner(name, num, cat, label, p, key).fit(part)

    jobs = [fit(n, ready.where(F.col("fold") != f)) for f in range(folds) for n in LEARNERS]
    jobs += [fit(n, ready) for n in LEARNERS]
    fitted = _parallel(jobs, threads)
    oof = None
    for f in range(folds):
        part = ready.where(F.col("fold") == f).select(key, label, *num, *cat)
        for i, n in enumerate(LEARNERS):
            part = add_probability(fitted[f * len(LEARNERS) + i], part, n)
        part = part.select(key, label, *[f"p_{n}" for n in LEARNERS])
        oof = part if oof is None else oof.unionByName(part)
    oof = materialize(oof, "stack-oof")
    vec = VectorAssembler(inputCols=[f"p_{n}" for n in LEARNERS], outputCol="__meta")
    meta = LogisticRegression(featuresCol="__meta", labelCol=label, predictionCol="__pred_meta",
                              probabilityCol="__prob_meta", rawPredictionCol="__raw_meta",
                              regParam=1.0 / max(1, oof.count()), standardization=False).fit(vec.transform(oof))
    base = dict(zip(LEARNERS, fitted[-len(LEARNERS):]))
    return StackedModel(own.preprocessor, base, meta, num, cat)


def fit_stack(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], key: str,
              label: str = "churned", folds: int = 5, params: dict | None = None, threads: int | None = None) -> StackedModel:
    """The stack of all learners; the preprocessed rows are written once, then read by every fit.

    ``params`` are settings of all learners, or of one under its name.
    """
    return fit_prepared(prepare(df, numeric, categorical, key, label, folds), params, threads)


def auc_of(df: DataFrame, score: str, label: str) -> float:
    row = metrics.roc_auc(df.withColumn("__g", F.lit(1)), ["__g"], score, label).first()
    return float(row.roc_auc) if row and row.roc_auc is not None else float("nan")


def random_trials(n: int, seed: int = SEED, space: dict | None = None) -> list[dict]:
    """Settings drawn from a space: of each learner from its own, or of all from one flat space."""
    rng = random.Random(seed)
    space = space or SEARCH_SPACE

    def draw(own: dict) -> dict:
        return {k: draw(v) if isinstance(v, dict) else rng.choice(v) for k, v in own.items()}

    return [draw(space) for _ in range(n)]


@dataclass
class Trials:
    """A search's trials, and the hold-out probabilities that each was judged by (trial, fold, label, p)."""

    best: dict
    done: list[dict]
    scores: DataFrame


def _judged(model: StackedModel, hold: DataFrame, trial: int, fold: int, label: str) -> tuple[DataFrame, float]:
    rows = materialize(model.probabilities(hold).select(
        F.lit(trial).alias("trial"), F.lit(fold).alias("fold"), F.col(label).alias("label"), "p"), "trial-scores")
    return rows, auc_of(rows, "p", "label")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def search(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], key: str, label: str = "churned",
           trials: int = 3, folds: int = 3, space: dict | None = None, threads: int = 3) -> Trials:
    """Search over all learners' own settings on one stratified hold-out, by AUC.

    The training part is preprocessed once for all trials, which run ``threads`` at a time.
    """
    parts = materialize(
        stratified_split(df.select(key, label, *numeric, *categorical), key, label, 20), "tuning-rows")
    train, hold = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")
    ready = prepare(train, numeric, categorical, key, label, folds)
    drawn, each = random_trials(trials, space=space), -(-ready.threads // threads)
    found = _parallel([lambda i=i, p=p: _judged(fit_prepared(ready, p, each), hold, i, 0, label) for i, p in enumerate(drawn)], threads)
    done = [{"trial": i, "params": p, "auc": auc, "pruned": False} for i, (p, (_, auc)) in enumerate(zip(drawn, found))]
    return Trials(max(done, key=lambda t: t["auc"])["params"], done, _union([s for s, _ in found]))


def search_cv(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], key: str, label: str = "churned",
              trials: int = 5, folds: int = 3, space: dict | None = None, threads: int = 3) -> Trials:
    """Search by the mean AUC of folds: all trials take a fold at the same time, and those below its median stop there.

    Each fold's training rows are preprocessed once for all trials.
    """
    ready = materialize(kfold(df.select(key, label, *numeric, *categorical), key, label, folds, "outer"), "cv-rows")
    done = [{"trial": i, "params": p, "folds": [], "pruned": False} for i, p in enumerate(random_trials(trials, space=space))]
    scores = []
    for f in range(folds):
        own = prepare(ready.where(F.col("outer") != f).drop("outer"), numeric, categorical, key, label, folds)
        hold = ready.where(F.col("outer") == f).drop("outer")
        going, each = [t for t in done if not t["pruned"]], -(-own.threads // threads)
        found = _parallel([lambda t=t: _judged(fit_prepared(own, t["params"], each), hold, t["trial"], f, label) for t in going], threads)
        for t, (rows, auc) in zip(going, found):
            t["folds"].append(auc)
            scores.append(rows)
        middle = sorted(t["folds"][f] for t in going)[(len(going) - 1) // 2]
        for t in going:
            t["pruned"] = f + 1 < folds and t["folds"][f] < middle
    for t in done:
        t["auc"] = sum(t["folds"]) / len(t["folds"])
    best = max([t for t in done if not t["pruned"]], key=lambda t: t["auc"])
    return Trials(best["params"], done, _union(scores))


def _listed(found: Trials) -> tuple[dict, list[dict]]:
    return found.best, [{**t["params"], **{k: v for k, v in t.items() if k != "params"}} for t in found.done]


def tune(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], key: str, label: str = "churned",
         trials: int = 3, folds: int = 3, space: dict | None = None) -> tuple[dict, list[dict]]:
    """The best settings of ``search`` and every trial with its settings and score."""
    return _listed(search(df, numeric, categorical, key, label, trials, folds, space))


def tune_cv(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], key: str, label: str = "churned",
            trials: int = 5, folds: int = 3, space: dict | None = None) -> tuple[dict, list[dict]]:
    """The best settings of ``search_cv`` and every trial with its settings, scores and whether it was pruned."""
    return _listed(search_cv(df, numeric, categorical, key, label, trials, folds, space))


def train_proxy(df: DataFrame, label: str, columns: Sequence[str], keep: Sequence[str],
                iterations: int = 50, also: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Small boosted trees on the upload's own numeric columns.

    Returns ``(*keep, proxy_probability)`` for all rows (of ``also``, if given) and the hold-out AUC.
    """
    key = keep[0]
    def filled_of(rows: DataFrame) -> DataFrame:
        return rows.select(*keep, F.col(label).cast("double").alias(label),
                           *[F.coalesce(to_number(F.col(c)), F.lit(0.0)).alias(c) for c in columns])

    filled = filled_of(df)
    parts = materialize(stratified_split(filled, key, label, 20), "proxy-rows")
    vec = VectorAssembler(inputCols=list(columns), outputCol="__vec_proxy")
    gbt = _named(GBTClassifier(labelCol=label, maxIter=iterations, maxDepth=3, stepSize=0.1, seed=SEED), "proxy")
    model = Pipeline(stages=[vec, gbt]).fit(parts.where("part = 'train'"))
    scored = add_probability(model, parts, "proxy")
    auc = auc_of(scored.where("part = 'test'"), "p_proxy", label)
    if also is not None:
        scored = add_probability(model, filled_of(also), "proxy")
    return scored.select(*keep, F.col("p_proxy").alias("proxy_probability")), auc


def importance_table(spark, model: StackedModel) -> DataFrame:
    return spark.createDataFrame(model.importances(), "feature string, importance double")


def actionable_weight(importances: DataFrame, feature: str) -> float:
    """Share of importance, in percent, held by a feature or its encodings."""
    own = (F.col("feature") == feature) | F.col("feature").startswith(feature + "_")
    row = importances.agg(F.sum("importance").alias("t"), F.sum(F.when(own, F.col("importance"))).alias("w")).first()
    return round(100.0 * (row.w or 0.0) / row.t, 1) if row.t else 25.0

