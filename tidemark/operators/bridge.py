"""Align an arbitrary customer table with an industry schema and report how it went."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars as S
from tidemark.operators import align, matcher
from tidemark.operators.impute import CorrelationImputer
from tidemark.session import materialize

ROW = "__row"


@dataclass
class Bridged:
    """An aligned table, how its columns map, its report and (maybe) a proxy score column."""

    df: DataFrame
    industry: str
    mapping: dict[str, str]
    sources: dict[str, str]
    mapped: list[str]
    missing: list[str]
    proxy_column: str | None
    proxy_auc: float | None
    report: DataFrame

    @property
    def overlap(self) -> float:
        return len(self.mapped) / len(catalog.SCHEMAS[self.industry])


class FeatureBridge:
    """Column mapping, correlation imputation and, for low overlap, a proxy model.

    ``training`` is the industry's training table; without it absent columns take static
    defaults.  ``proxy`` trains a proxy model: ``(df, label, columns) -> (df with column, auc)``.
    """

    def __init__(self, industry: str | None = None, training: DataFrame | None = None,
                 imputer: CorrelationImputer | None = None, proxy=None):
        self.industry, self.training, self.imputer, self.proxy = industry, training, imputer, proxy

    def mapping(self, df: DataFrame, keep: tuple[str, ...] = ()) -> dict[str, str]:
        """The schema's feature for each header that has one, by the industry given."""
        headers = [c for c in df.columns if c not in keep and catalog.clean(c) not in catalog.target_words()]
        return matcher.map_columns(df.sparkSession, headers, self.industry)

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> Bridged:
        spark = df.sparkSession
        headers = [c for c in df.columns if c not in keep]
        target = next((h for h in headers if catalog.clean(h) in catalog.target_words()), None)
        features = [h for h in headers if h != target]
        industry = self.industry or matcher.detect_industry(spark, headers)
        mapping = matcher.map_columns(spark, features, industry)
        if target is not None:
            mapping[target] = "churned"
        schema = catalog.SCHEMAS[industry]
        overlap = len(set(mapping.values()) & set(schema)) / len(schema)
        wants_proxy = overlap < 0.40 and target is not None and self.proxy is not None
        if wants_proxy:
            # ids may repeat or be missing: proxy scores find their rows by a number that is written with them
            df = materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered-upload")
        mapped_df = align.rename_mapped(df, mapping)
        if target is not None:
            mapped_df = mapped_df.withColumn("churned", S.map_target_values(F.col("churned").cast("string")))
        if "signup_year" in mapped_df.columns:
            mapped_df = mapped_df.withColumn("signup_year", S.extract_year(F.col("signup_year")))
        have = set(mapped_df.columns)
        mapped, missing = [c for c in schema if c in have], [c for c in schema if c not in have]

        imputer = self.imputer
        if imputer is None and self.training is not None:
            imputer = CorrelationImputer(industry).fit(self.training)
        if imputer is not None:
            values, sources = imputer.impute(mapped, missing)
        else:
            values = {c: F.lit(catalog.DEFAULTS[c]) for c in missing}
            sources = {c: "static_default" for c in missing}
        bridged = mapped_df.withColumns(values) if values else mapped_df

        proxy_column, auc = None, None
        if wants_proxy:
            label = S.map_target_values(F.col(f"`{target}`").cast("string"))
            skip = {target, ROW, *keep, *align.id_like_names(headers)}
            usable = [c for c in align.numeric_names(df) if c not in skip]
            labelled = df.select(ROW, label.alias("churned"), *usable)
            if align.proxy_gate(labelled.drop(ROW), "churned", overlap).first().train_proxy:
                scored, auc = self.proxy(labelled, "churned", usable, [ROW])
                bridged, proxy_column = bridged.join(scored, ROW, "left"), "proxy_probability"
        extra = [c for c in (*keep, "churned", "customer_id", proxy_column) if c and c in bridged.columns]
        aligned = bridged.select(*extra, *[F.col(c) for c in schema])
        report = self._report(spark, industry, overlap, mapping, mapped, missing, sources, auc)
        return Bridged(aligned, industry, mapping, sources, mapped, missing, proxy_column, auc, report)

    def _report(self, spark, industry, overlap, mapping, mapped, missing, sources, auc) -> DataFrame:
        def strings(xs) -> Column:
            return F.array(*[F.lit(x) for x in xs]).cast("array<string>")

        def pairs(d: dict[str, str]) -> Column:
            if not d:
                return F.create_map().cast("map<string,string>")
            return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])

        counts = {k: sum(1 for s in sources.values() if s == k)
                  for k in ("correlation", "training_median", "training_mode", "static_default")}
        pct = round(overlap * 100, 1)
        shown = {h: f for h, f in mapping.items() if f in catalog.SCHEMAS[industry] or f == "churned"}
        warnings = align.quality_warnings(
            F.lit(overlap), F.lit(pct), F.lit(len(missing)), F.lit(industry), F.lit(counts["correlation"]),
            F.lit(counts["static_default"]), None if auc is None else F.lit(float(auc)))
        notes = [
            F.lit(f"Feature '{c}' was missing and filled with static default ({catalog.DEFAULTS[c]}).")
            for c in missing if sources[c] == "static_default"
        ]
        if notes:
            warnings = F.concat(warnings, F.array(*notes))
        return spark.range(1).select(
            F.lit(industry).alias("detected_industry"), F.lit(pct).alias("schema_overlap_pct"),
            F.lit(len(mapped) + len(missing)).alias("total_schema_features"),
            F.lit(len(mapped)).alias("mapped_features_count"), strings(mapped).alias("mapped_features"),
            F.lit(len(missing)).alias("imputed_features_count"), strings(missing).alias("missing_features"),
            F.struct(
                F.lit(counts["correlation"]).alias("correlation_imputed"),
                F.lit(counts["training_median"]).alias("training_median"),
                F.lit(counts["training_mode"]).alias("training_mode"),
                F.lit(counts["static_default"]).alias("static_default")).alias("imputation_breakdown"),
            pairs(shown).alias("column_mapping"), pairs(sources).alias("imputation_sources"),
            F.struct(F.lit(auc is not None).alias("used"),
                     F.lit(None if auc is None else round(auc, 4)).cast("double").alias("auc")).alias("proxy_model"),
            warnings.alias("data_quality_warnings"))
