"""Schema alignment: leakage removal, typing, validation, cleaning and ordering of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import catalog
from tidemark.functions import scalars as S


class SchemaValidationError(Exception):
    """A table breaks the schema of its industry."""


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*catalog.LEAKAGE_COLUMNS)


def classifier_features(df: DataFrame, industry: str) -> DataFrame:
    """Drop target-adjacent columns, and tenure where it is the survival duration."""
    extra = ["tenure_months"] if industry in catalog.SURVIVAL_INDUSTRIES else []
    return df.drop(*catalog.NON_FEATURE_COLUMNS, *extra)


def clean_billing(df: DataFrame, amount: str, label: str, key: str | None = None) -> DataFrame:
    """Blank amounts to 0.0, Yes/No labels to 1/0, identifier dropped."""
    out = df.withColumns({
        amount: F.coalesce(S.to_number(S.blank_to_null(F.col(amount))), F.lit(0.0)),
        label: F.when(F.col(label) == "Yes", 1).when(F.col(label) == "No", 0),
    })
    return out.drop(key) if key else out


def rename_mapped(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename headers to features; of several headers for one feature the first is kept."""
    taken: set[str] = set()
    cols = []
    for c in df.columns:
        name = mapping.get(c, c)
        if name not in taken:
            taken.add(name)
            cols.append(F.col(f"`{c}`").alias(name))
    return df.select(*cols)


def first_of_each(headers: DataFrame) -> DataFrame:
    """(dataset_id, pos, header): of an upload's headers with one cleaned name (``clean``) the first is kept."""
    return headers.groupBy("dataset_id", "clean").agg(F.min(F.struct("pos", "header")).alias("first")).select(
        "dataset_id", "first.*")


def typed_headers(headers: DataFrame) -> DataFrame:
    """(dataset_id, pos, industry, feature, kind) for headers named like a schema feature, by ``feature_types``."""
    spark = headers.sparkSession
    kinds = [(industry, f, kind) for industry, schema in catalog.SCHEMAS.items()
             for kind, found in zip(("numeric", "categorical"), feature_types(schema, industry)) for f in found]
    known = spark.createDataFrame([(*k, catalog.clean(k[1])) for k in kinds],
                                  "industry string, feature string, kind string, feature_clean string")
    return headers.join(F.broadcast(known), F.col("clean") == F.col("feature_clean")).select(
        "dataset_id", "pos", "industry", "feature", "kind")


def restore_headers(df: DataFrame, headers: Sequence[str], mapping: Mapping[str, str]) -> list[Column]:
    """Aligned columns under their uploaded names; NULL where nothing was aligned."""
    have = set(df.columns)
    return [
        (F.col(f"`{mapping.get(h, h)}`") if mapping.get(h, h) in have else F.lit(None).cast("string")).alias(h)
        for h in headers
    ]


def feature_types(columns: Sequence[str], industry: str) -> tuple[list[str], list[str]]:
    """(numeric, categorical) schema features among ``columns``, in their order."""
    skip = {*catalog.NON_FEATURE_COLUMNS, *(["tenure_months"] if industry in catalog.SURVIVAL_INDUSTRIES else [])}
    found = [c for c in columns if c in catalog.SCHEMAS[industry] and c not in skip]
    return ([c for c in found if catalog.ROLES[c] != "text"], [c for c in found if catalog.ROLES[c] == "text"])


def expected_type(feature: str, df: DataFrame | None = None) -> str:
    """``double`` or ``string``: the parsed type when present, else the catalog's."""
    if df is not None and feature in df.columns:
        kind = df.schema[feature].dataType
        return "string" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else "double"
    return "string" if catalog.ROLES[feature] == "text" else "double"


def validate(df: DataFrame, industry: str) -> DataFrame:
    """Leakage dropped, schema columns coerced to their type, absent ones added as NULL.

    Extra columns pass through.  Values that do not fit become NULL; ``violations`` lists
    them and ``require_valid_target`` rejects a bad label.
    """
    out = drop_leakage(df)
    casts: dict[str, Column] = {}
    for f in catalog.SCHEMAS[industry]:
        kind = expected_type(f, out)
        if f not in out.columns:
            casts[f] = F.lit(None).cast(kind)
        else:
            casts[f] = S.to_number(F.col(f)) if kind == "double" else F.col(f).cast("string")
    if "churned" in out.columns:
        casts["churned"] = S.to_int(S.to_number(F.col("churned")))
    return out.withColumns(casts)


def violations(df: DataFrame, numeric: Sequence[str], key: str) -> DataFrame:
    """(key, column, value) for present values that are not numbers."""
    long = df.select(F.col(key), *[F.col(c).cast("string").alias(c) for c in numeric]).unpivot(
        [key], list(numeric), "column", "value")
    return long.where(F.col("value").isNotNull() & S.to_number(F.col("value")).isNull())


def target_violations(df: DataFrame, label: str = "churned") -> DataFrame:
    """Rows whose label is missing or not 0/1."""
    number = S.to_number(F.col(label))
    return df.where(number.isNull() | ~number.isin(0.0, 1.0))


def require_valid_target(df: DataFrame, label: str = "churned") -> None:
    bad = target_violations(df.select(label), label).limit(10).collect()
    if bad:
        raise SchemaValidationError(f"{label} must be 0 or 1, found {[r[0] for r in bad]}")


def id_like(name: Column, whole_token: bool = False) -> Column:
    """Whether a column name contains an identifier keyword (or is made of one)."""
    words = "|".join(catalog.ID_LIKE_KEYWORDS)
    low = F.lower(name)
    return low.rlike(rf"(^|[_\s])({words})($|[_\s])") if whole_token else low.rlike(words)


def id_like_names(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(k in c.lower() for k in catalog.ID_LIKE_KEYWORDS)]


def clean_value(feature: str, x: Column) -> Column:
    """One uploaded value cast to its feature's type, with the catalog default."""
    default, cast = catalog.DEFAULTS[feature], catalog.CASTS[feature]
    if feature == "signup_year":
        return S.extract_year(x, default)
    if cast == "text":
        return F.coalesce(S.blank_to_null(x.cast("string")), F.lit(default))
    if cast == "flag":
        return S.parse_binary(x, default)
    if cast == "int":
        return F.coalesce(S.to_int(S.to_number(x)), F.lit(int(default)))
    return S.coerce_numeric(x, default)


def clean_features(df: DataFrame, industry: str, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the schema's columns in order, typed and without gaps, plus ``keep``."""
    have = set(df.columns)
    absent = F.lit(None).cast("string")
    return df.select(
        *keep, *[clean_value(f, F.col(f) if f in have else absent).alias(f) for f in catalog.SCHEMAS[industry]])


def schema_align(df: DataFrame, industry: str, keep: Sequence[str] = ()) -> DataFrame:
    """Schema-ordered projection with default fill and unchanged types."""
    have = set(df.columns)
    cols = [
        (F.coalesce(F.col(f), F.lit(catalog.DEFAULTS[f])) if f in have else F.lit(catalog.DEFAULTS[f])).alias(f)
        for f in catalog.SCHEMAS[industry]
    ]
    return df.select(*keep, *cols)


def valid_targets(df: DataFrame, label: str, vocabulary: str = "augment") -> DataFrame:
    """Map label spellings to 0/1 and drop the rows whose label does not map."""
    return df.withColumn(label, S.map_target_values(F.col(label).cast("string"), vocabulary, "drop")).dropna(subset=[label])


def cast_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: S.cast_training_flag(F.col(c)) for c in columns})


def flags_or_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as numbers: by flag words where any value of the column is one, else value by value.

    In a column of flags whatever is no flag word takes the default, numbers too; a column without one is parsed.
    One aggregate looks at all columns.
    """
    def flag(c: str) -> Column:
        return S.lookup(F.lower(F.trim(F.col(c).cast("string"))), catalog.TRAINING_FLAG_WORDS)

    row = df.agg(*[F.count(flag(c)).alias(c) for c in columns]).first() if columns else {}
    return df.withColumns({
        c: F.coalesce((flag(c) if row[c] else S.to_number(F.col(c))).cast("double"), F.lit(float(catalog.DEFAULTS.get(c) or 0)))
        for c in columns})


# ---------------------------------------------------------------------------
# Overlap and provenance per upload
# ---------------------------------------------------------------------------
def feature_status(mapping: DataFrame, industries: DataFrame) -> DataFrame:
    """(dataset_id, industry, feature, pos, mapped) over every upload's schema."""
    spark = mapping.sparkSession
    schema = F.broadcast(catalog.feature_catalog(spark).select("industry", "feature", F.col("pos").alias("fpos")))
    wanted = industries.select("dataset_id", "industry").join(schema, "industry")
    found = mapping.select("dataset_id", "feature", F.lit(True).alias("hit"))
    return wanted.join(found, ["dataset_id", "feature"], "left").select(
        "dataset_id", "industry", "feature", "fpos", F.coalesce("hit", F.lit(False)).alias("mapped"))


def schema_overlap(status: DataFrame) -> DataFrame:
    share = F.avg(F.col("mapped").cast("int"))
    return status.groupBy("dataset_id", "industry").agg(
        F.count(F.when(F.col("mapped"), 1)).alias("mapped_features"),
        F.count(F.when(~F.col("mapped"), 1)).alias("missing_features"),
        S.stable_round(share * 100, 1).alias("overlap_pct"))


def quality_warnings(overlap: Column, overlap_pct: Column, missing: Column, industry: Column,
                     correlation: Column, defaults: Column, proxy_auc: Column | None = None) -> Column:
    """Data-quality warnings of an alignment report as an array of strings."""
    def s(x: Column) -> Column:
        return x.cast("string")

    rules = [
        F.when(overlap < 0.30, F.concat(
            F.lit("Very low schema overlap ("), s(overlap_pct), F.lit("%). Predictions may be unreliable. "
            "Consider a dataset closer to the "), industry, F.lit(" domain."))),
        F.when((overlap >= 0.30) & (overlap < 0.50), F.concat(
            F.lit("Moderate schema overlap ("), s(overlap_pct), F.lit("%). "), s(missing),
            F.lit(" features were statistically imputed."))),
        F.when(correlation > 0, F.concat(s(correlation), F.lit(
            " feature(s) were imputed using inter-feature correlations learned from the training data."))),
        F.when(defaults > 3, F.concat(s(defaults), F.lit(
            " feature(s) fell back to static defaults. This may reduce prediction accuracy."))),
    ]
    if proxy_auc is not None:
        auc = F.format_number(proxy_auc, 3)
        rules.append(F.when(proxy_auc > 0.65, F.concat(
            F.lit("Proxy model trained on raw user features achieved AUC="), auc,
            F.lit(". Predictions will be blended."))))
        rules.append(F.when(proxy_auc <= 0.65, F.concat(
            F.lit("Proxy model AUC is low ("), auc, F.lit("). Blending weight will be reduced."))))
    return F.array_compact(F.array(*rules))


def proxy_gate(df: DataFrame, label: str | None, overlap: float) -> DataFrame:
    """One row of facts deciding whether a proxy model is worth training."""
    usable = [f.name for f in df.schema.fields
              if isinstance(f.dataType, T.NumericType) and f.name != label and f.name not in id_like_names([f.name])]
    classes = (F.max(label) != F.min(label)) if label else F.lit(False)
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(classes, F.lit(False)).alias("two_classes"))
    return facts.select(
        "rows", F.lit(len(usable)).alias("numeric_columns"), "two_classes", F.lit(float(overlap)).alias("overlap"),
        ((F.col("rows") >= 50) & F.lit(len(usable) >= 2) & F.col("two_classes")
         & F.lit(label is not None) & F.lit(overlap < 0.40)).alias("train_proxy"))


def numeric_names(df: DataFrame) -> list[str]:
    """Columns that are numeric by type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
