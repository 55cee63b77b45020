"""Serving jobs: score an uploaded table or one record against an industry's reference rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars as S
from tidemark.operators import align as A
from tidemark.operators import conformal as CF
from tidemark.operators import knn as K
from tidemark.operators import preprocess as PP
from tidemark.operators import scoring as SC
from tidemark.operators.bridge import ROW, Bridged, FeatureBridge
from tidemark.operators.impute import CorrelationImputer
from tidemark.operators.knn_index import Index, build, search
from tidemark.operators.models import StackedModel
from tidemark.operators.store import Store, Version
from tidemark.session import materialize, pin

EVIDENCE = ["segment", "tenure", "contract", "monthly_charges", "detail", "churned_text"]


def evidence_payload(df: DataFrame) -> DataFrame:
    """Reference rows as shown next to a prediction; absent features take their default."""
    have = set(df.columns)
    cols = {f: (F.coalesce(F.col(f), F.lit(catalog.DEFAULTS[f])) if f in have else F.lit(catalog.DEFAULTS[f]))
            for f in catalog.FEATURES}
    return df.select(
        F.col("customer_id").alias("rid"), "churned",
        F.concat(F.initcap(cols["customer_segment"]), F.lit(" segment")).alias("segment"),
        cols["tenure_months"].cast("int").alias("tenure"), cols["contract_type"].alias("contract"),
        cols["monthly_spend_usd"].alias("monthly_charges"),
        S.evidence_detail(F.col("industry"), cols).alias("detail"),
        F.when(F.col("churned") == 1, "Yes").otherwise("No").alias("churned_text"))


@dataclass
class ServingState:
    """What scoring needs of an industry: nothing here is fitted again when rows are scored.

    ``references`` are scaled vectors (grp, rid, vec), ``payload`` what is shown of them; ``scorer`` is a fitted
    ``StackedModel`` or any function of rows; ``hazards``, ``imputer`` and ``index`` may be absent.
    """

    industry: str
    features: list[str]
    stats: DataFrame
    references: DataFrame
    payload: DataFrame
    quantiles: DataFrame
    scorer: Callable[[DataFrame, str], DataFrame]
    imputer: CorrelationImputer | None = None
    hazards: DataFrame | None = None
    index: Index | None = None


def fit_state(industry: str, train: DataFrame, val: DataFrame, scorer: Callable[[DataFrame, str], DataFrame],
              features: Sequence[str] | None = None, key: str = "customer_id", imputer: CorrelationImputer | None = None,
              hazards: DataFrame | None = None, indexed: bool = False, scored: DataFrame | None = None) -> ServingState:
    """Fit what surrounds a scorer: quantiles on ``val``, scaling and references on ``train``.

    Both are cleaned rows of the industry with ``key`` and ``churned``; ``features`` span the retrieval space (all
    numeric ones by default); ``indexed`` builds a neighbour index over the references.  ``scored`` are the rows of
    ``val`` as the scorer has scored them already (churned, p, industry); otherwise they are scored here, once.
    """
    by = F.lit(industry).alias("industry")
    if scored is None:
        # written, as quantiles take several passes and a model costs more than its scores
        scored = materialize(scorer(val, "p").select("churned", "p", by), "calibration")
    quantiles = CF.calibrate(scored, ["industry"])
    space = [f for f in features or A.feature_types(train.columns, industry)[0] if f in catalog.SCHEMAS[industry]]
    stats = pin(PP.scaling_stats(train.select("*", by), space, ["industry"]))
    scaled = PP.standard_scale(train.select("*", by), stats, space, ["industry"])
    references = K.vectors(scaled, key, space, "industry", "rid")
    payload = evidence_payload(train.select("*", by))
    return ServingState(industry, space, stats, references, payload, quantiles, scorer, imputer, hazards,
                        build(references) if indexed else None)


def publish_state(store: Store, state: ServingState, batch: str = "", after: Version | None = None,
                  meta: dict | None = None, folder: str | None = None) -> Version:
    """Write a state into a folder of its own and make it the store's newest version."""
    folder = folder or store.stage()
    for name in ("stats", "references", "payload", "quantiles", "hazards"):
        if (df := getattr(state, name)) is not None:
            df.write.parquet(f"{folder}/{name}")
    if isinstance(state.scorer, StackedModel):
        state.scorer.save(f"{folder}/model")
    if state.index is not None:
        state.index.save(f"{folder}/index")
    own = {"industry": state.industry, "features": state.features,
           "imputer": None if state.imputer is None else asdict(state.imputer)}
    return store.publish(folder, {**(meta or {}), **own}, batch, after)


def load_state(store: Store, scorer: Callable[[DataFrame, str], DataFrame] | None = None, version: Version | None = None) -> ServingState:
    """A published state, the newest by default; ``scorer`` where the state holds no model of its own."""
    version = version or store.current()
    if version is None:
        raise KeyError("nothing has been published")
    if store.has("model", version):
        scorer = StackedModel.load(f"{version.folder}/model")
    if scorer is None:
        raise ValueError("the state holds no model: name a scorer")
    meta, imputer = version.meta, None
    if meta["imputer"] is not None:
        saved = dict(meta["imputer"])
        saved["models"] = {k: (float(b), beta) for k, (b, beta) in saved["models"].items()}
        imputer = CorrelationImputer(**saved)
    tables = {n: store.table(n, version) for n in ("stats", "references", "payload", "quantiles")}
    return ServingState(
        meta["industry"], list(meta["features"]), **tables, scorer=scorer, imputer=imputer,
        hazards=store.table("hazards", version) if store.has("hazards", version) else None,
        index=Index.load(store.spark, f"{version.folder}/index") if store.has("index", version) else None)


def numbered(upload: DataFrame, key: str) -> DataFrame:
    """The upload with a number for each row, written so that it stays; ids may repeat or be absent."""
    rows = upload.withColumn(ROW, F.monotonically_increasing_id())
    if not any(catalog.clean(h) in catalog.true_id_words() for h in upload.columns):
        rows = rows.withColumn(key, F.col(ROW))
    return materialize(rows, "numbered-upload")


def score_with(state: ServingState, upload: DataFrame, level_pct: int = catalog.DEFAULT_LEVEL_PCT,
               bridge: FeatureBridge | None = None, key: str = "customer_id", bridged: Bridged | None = None) -> tuple[Bridged, DataFrame]:
    """Align, clean, score, attach sets, evidence and the what-if by a state; one lazy table of rows."""
    if bridged is None:
        bridged = (bridge or FeatureBridge(state.industry, imputer=state.imputer)).transform(numbered(upload, key), (ROW,))
    proxy = [bridged.proxy_column] if bridged.proxy_column else []
    cleaned = A.clean_features(bridged.df, state.industry, [ROW, key, *proxy])
    qhat = state.quantiles.where(F.col("level_pct") == level_pct).first().qhat
    by = F.lit(state.industry).alias("industry")
    q = K.vectors(PP.standard_scale(cleaned.select("*", by), state.stats, state.features, ["industry"]), ROW, state.features, "industry", "qid")
    hits = K.knn_join(q, state.references) if state.index is None else search(state.index, q)
    retrieval = K.summarise(hits, state.payload, [F.col(c) for c in EVIDENCE])
    rows = SC.score_rows(cleaned, ROW, state.industry, state.scorer, qhat, retrieval, bridged.proxy_column, bridged.overlap)
    return bridged, rows.drop(ROW)


def score_upload(upload: DataFrame, train: DataFrame, val: DataFrame, scorer: Callable[[DataFrame, str], DataFrame],
                 features: Sequence[str] | None = None, level_pct: int = catalog.DEFAULT_LEVEL_PCT,
                 bridge: FeatureBridge | None = None, key: str = "customer_id") -> tuple[Bridged, DataFrame]:
    """Fit a state for the upload's industry and score by it; ``publish_state`` and ``score_with`` do the two apart.

    ``train`` and ``val`` are cleaned rows of the detected industry with ``key`` and ``churned``.  Ids of any type will
    do, may repeat or be null, and an upload without one is numbered by row.
    """
    bridged = (bridge or FeatureBridge()).transform(numbered(upload, key), (ROW,))
    state = fit_state(bridged.industry, train, val, scorer, features, key)
    return score_with(state, upload, level_pct, key=key, bridged=bridged)


def predict_record(payload: str, industry: str, train: DataFrame, val: DataFrame, scorer, schema,
                   level_pct: int = catalog.DEFAULT_LEVEL_PCT) -> DataFrame:
    """One JSON record through the batch operators, with its risk drivers; all ten industries."""
    from tidemark.sources.tables import record_frame

    record = record_frame(train.sparkSession, payload, schema)
    if "customer_id" not in record.columns:
        record = record.withColumn("customer_id", F.lit(0).cast("bigint"))
    bridged, rows = score_upload(record, train, val, scorer, level_pct=level_pct, bridge=FeatureBridge(industry))
    have = set(rows.columns)
    cols = {f: F.col(f) if f in have else F.lit(catalog.DEFAULTS[f]) for f in catalog.FEATURES}
    tier = S.action_tier(F.col("in0"), F.col("in1"))
    gain = F.greatest(F.col("p_final") - F.col("p_opt_final"), F.lit(0.0))
    return rows.select(
        F.round(F.col("p_final") * 100, 2).alias("churn_probability"),
        F.when(F.col("p_final") >= 0.5, "Yes").otherwise("No").alias("prediction"),
        tier.alias("risk_level"), S.set_label(F.col("in0"), F.col("in1")).alias("prediction_set"),
        S.suggested_action(tier).alias("recommendation"),
        S.risk_drivers(F.lit(industry), cols).alias("drivers"), "sources",
        F.round(gain * 100, 1).alias("impact"), F.round(F.col("p_opt_final") * 100, 1).alias("new_prob"),
        F.when(K.out_of_distribution(F.col("avg_similarity")), "OOD Warning").otherwise("Safe Alignment").alias("safety_status"),
        F.round("avg_similarity", 1).alias("avg_similarity"))
