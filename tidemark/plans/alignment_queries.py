"""Sources, projections, cleaning and schema alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars as S
from tidemark.operators import align as A
from tidemark.operators import matcher as MT
from tidemark.operators.preprocess import TypeCaster
from tidemark.operators.selection import ordinal
from tidemark.plans import common, header_queries  # noqa: F401
from tidemark.plans.registry import define_cte, query, rnd
from tidemark.session import materialize, scratch_path
from tidemark.sources import customers as C
from tidemark.sources import tables as TB
from tidemark.sources import uploads as U


def _arr(words) -> str:
    return "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in words) + "]"


define_cte("dirty", f"""
SELECT c_custkey AS id,
  CASE c_custkey % 10 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || CAST(c_acctbal AS VARCHAR) || ' ' WHEN 2 THEN 'x' || CAST(c_acctbal AS VARCHAR)
    WHEN 3 THEN NULL ELSE CASE c_custkey % 50 WHEN 4 THEN 'Infinity' WHEN 5 THEN '3000000000' ELSE CAST(c_acctbal AS VARCHAR) END END AS num,
  {_arr(U.FLAG_SPELLINGS)}[c_custkey % {len(U.FLAG_SPELLINGS)} + 1] AS flag,
  CASE c_custkey % 6 WHEN 0 THEN CAST(1990 + c_custkey % 35 AS VARCHAR) || '-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')
    WHEN 1 THEN CAST(1990 + c_custkey % 35 AS VARCHAR) WHEN 2 THEN CAST(1990 + c_custkey % 35 AS VARCHAR) || '.0' WHEN 3 THEN 'abc' WHEN 4 THEN NULL ELSE '5' END AS joined,
  {_arr(U.LABEL_SPELLINGS)}[c_custkey % {len(U.LABEL_SPELLINGS)} + 1] AS label
FROM customer""")

NUM = "CASE WHEN isfinite(try_cast(trim(num) AS DOUBLE)) THEN try_cast(trim(num) AS DOUBLE) END"
FLAG = "coalesce(CASE WHEN lower(trim(flag)) IN ('yes','true','1','onboarded','enabled') THEN 1 WHEN lower(trim(flag)) IN ('no','false','0','disabled') THEN 0 END, CAST(trunc(try_cast(trim(flag) AS DOUBLE)) AS INTEGER), {d})"
YEAR = """CAST(CASE WHEN try_cast(trim(joined) AS DOUBLE) BETWEEN 1900 AND 2100 THEN trunc(try_cast(trim(joined) AS DOUBLE))
  WHEN try_cast(trim(joined) AS DOUBLE) IS NULL THEN coalesce(year(try_cast(trim(joined) AS DATE)), 2024) ELSE 2024 END AS INTEGER)"""
LABEL_INGEST = "CASE WHEN label IN ('Yes','yes','YES','True','true','1','Attrited Customer') THEN 1 WHEN label IN ('No','no','NO','False','false','0','Existing Customer') THEN 0 END"
LABEL_AUGMENT = "CASE WHEN label IN ('Yes','yes','1','True','true','churned','Exited','exited') THEN 1 WHEN label IN ('No','no','0','False','false','retained') THEN 0 END"


# --- sources ---------------------------------------------------------------
@query("scan_csv", sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, base):
    df = TB.table(spark, base, "customer")
    path = scratch_path(spark, "customer-csv")
    df.write.option("header", "true").csv(path)
    return TB.read_csv(spark, path, df.schema)


@query("scan_partitioned_split", ctes=("c360",), sql="""
SELECT customer_id, churned, industry, split FROM c360 WHERE industry = 'saas' AND split = 'val'""")
def scan_partitioned_split(spark, base):
    path = scratch_path(spark, "splits")
    TB.write_splits(C.feature_table(spark, base), path)
    return TB.read_split(spark, path, "saas", "val").select("customer_id", "churned", "industry", "split")


@query("augmented_union", ctes=("c360",), sql="""
SELECT customer_id, region, monthly_spend_usd, churned FROM c360 WHERE split = 'train'
UNION ALL SELECT customer_id, NULL, monthly_spend_usd, churned FROM c360 WHERE split = 'val'""")
def augmented_union(spark, base):
    df = C.feature_table(spark, base).select("customer_id", "region", "monthly_spend_usd", "churned", "split")
    parts = {s: df.where(F.col("split") == s).drop("split") for s in ("train", "val")}
    return TB.augmented(parts["train"], parts["val"].drop("region"))


@query("sample_head", sql="SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def sample_head(spark, base):
    return TB.sample_head(TB.table(spark, base, "customer"), ["c_custkey"], 10)


ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
              "conversations").split()


@query("file_catalog", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", 'Train Set (Reference)' AS kind, count(*) AS \"rows\", true AS sized FROM {t}" for t in ALL_TABLES))
def file_catalog(spark, base):
    found = reduce(DataFrame.unionByName, [
        TB.file_catalog(spark, f"{base}/{t}.parquet", "Train Set (Reference)").withColumn("table", F.lit(t)) for t in ALL_TABLES])
    return found.groupBy("table", "kind").agg(F.sum("rows").alias("rows"), F.bool_and(F.col("size_kb") > 0).alias("sized"))


# --- scalar functions over untidy values ------------------------------------
@query("map_target_values", ctes=("dirty",), sql=f"SELECT id, label, CAST(coalesce({LABEL_INGEST}, 0) AS INTEGER) AS churned FROM dirty")
def map_target_values(spark, base):
    return U.untidy_customers(spark, base).select("id", "label", S.map_target_values(F.col("label")).alias("churned"))


@query("valid_targets", ctes=("dirty",), sql=f"""
SELECT id, CAST({LABEL_AUGMENT} AS INTEGER) AS label FROM dirty WHERE {LABEL_AUGMENT} IS NOT NULL""")
def valid_targets(spark, base):
    return A.valid_targets(U.untidy_customers(spark, base).select("id", "label"), "label")


@query("parse_binary", ctes=("dirty",), sql=f"SELECT id, flag, CAST({FLAG.format(d=0)} AS INTEGER) AS value FROM dirty")
def parse_binary(spark, base):
    return U.untidy_customers(spark, base).select("id", "flag", S.parse_binary(F.col("flag")).alias("value"))


@query("binary_cast", ctes=("dirty",), sql="""
SELECT id, CASE WHEN lower(trim(flag)) IN ('true','1','1.0','yes') THEN 1 ELSE 0 END AS flag FROM dirty""")
def binary_cast(spark, base):
    return A.cast_flags(U.untidy_customers(spark, base).select("id", "flag"), ["flag"])


_FLAG_COLUMN = "lower(trim(flag)) IN ('true','1','1.0','yes')"


@query("flags_or_numbers", ctes=("dirty",), sql=f"""
SELECT id, CASE WHEN {_FLAG_COLUMN} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag, coalesce({NUM}, 0.0::DOUBLE) AS num FROM dirty""")
def flags_or_numbers(spark, base):
    """One text column of flags and one of numbers, told apart by whether any value is a flag word."""
    return A.flags_or_numbers(U.untidy_customers(spark, base).select("id", "flag", "num"), ["flag", "num"])


@query("coerce_numeric", ctes=("dirty",), sql=f"SELECT id, coalesce({NUM}, 5000.0::DOUBLE) AS value FROM dirty")
def coerce_numeric(spark, base):
    return U.untidy_customers(spark, base).select("id", S.coerce_numeric(F.col("num"), 5000.0).alias("value"))


@query("extract_year", ctes=("dirty",), sql=f"SELECT id, joined, {YEAR} AS year FROM dirty")
def extract_year(spark, base):
    return U.untidy_customers(spark, base).select("id", "joined", S.extract_year(F.col("joined")).alias("year"))


@query("clean_blank_numeric", ctes=("dirty",), sql=f"""
SELECT coalesce({NUM}, 0.0::DOUBLE) AS num, CASE label WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS label FROM dirty""")
def clean_blank_numeric(spark, base):
    df = U.untidy_customers(spark, base).select("id", "num", "label")
    return A.clean_billing(df, "num", "label", "id")


@query("route_by_filename", sql="""
SELECT doc_id, CASE WHEN contains(lower(name), 'train') THEN 'Train Set' WHEN contains(lower(name), 'val') OR contains(lower(name), 'calib') THEN 'Validation Set'
  ELSE 'Split Train/Val (80/20)' END AS ingested_as
FROM (SELECT doc_id, source || CASE doc_id % 4 WHEN 0 THEN '_TRAIN.csv' WHEN 1 THEN '_validation.csv' WHEN 2 THEN '_Calib.csv' ELSE '.csv' END AS name FROM documents)""")
def route_by_filename(spark, base):
    docs = TB.table(spark, base, "documents")
    name = F.concat(F.col("source"), U.pick(("_TRAIN.csv", "_validation.csv", "_Calib.csv", ".csv"), F.col("doc_id") % 4))
    return docs.select("doc_id", S.route_by_filename(name).alias("ingested_as"))


# --- projections -------------------------------------------------------------
@query("drop_leakage", ctes=("c360",), sql="SELECT * EXCLUDE (customer_id, industry) FROM c360")
def drop_leakage(spark, base):
    return A.drop_leakage(C.feature_table(spark, base))


@query("classifier_features", ctes=("c360",), sql="""
SELECT * EXCLUDE (customer_id, industry, churned, tenure_months) FROM c360 WHERE industry = 'saas'""")
def classifier_features(spark, base):
    return A.classifier_features(C.feature_table(spark, base).where(F.col("industry") == "saas"), "saas")


RENAMES = {"CustomerKey": "customer_id", "Region": "region", "Tenure": "tenure_months", "MonthlyCharges": "monthly_spend_usd",
           "Tenure Months": "tenure_months"}


def _renamed_upload(spark, base):
    return C.feature_table(spark, base).select(
        F.col("customer_id").alias("CustomerKey"), F.col("region").alias("Region"),
        F.col("tenure_months").alias("Tenure"), F.col("monthly_spend_usd").alias("MonthlyCharges"),
        (F.col("tenure_months") * 2).alias("Tenure Months"))


@query("rename_mapped", ctes=("c360",), sql="SELECT customer_id, region, tenure_months, monthly_spend_usd FROM c360")
def rename_mapped(spark, base):
    return A.rename_mapped(_renamed_upload(spark, base), RENAMES)


@query("dedupe_columns", ctes=("hdr",), sql="""
SELECT dataset_id, pos, header FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, clean ORDER BY pos) AS rk FROM hdr) WHERE rk = 1""")
def dedupe_columns(spark, base):
    return A.first_of_each(MT.with_clean(U.upload_headers(spark, base)))


@query("restore_headers", ctes=("c360",), sql="""
SELECT customer_id AS "CustomerKey", region AS "Region", tenure_months AS "Tenure", monthly_spend_usd AS "MonthlyCharges",
  tenure_months AS "Tenure Months", CAST(NULL AS VARCHAR) AS "Notes" FROM c360""")
def restore_headers(spark, base):
    upload = _renamed_upload(spark, base)
    aligned = A.rename_mapped(upload, RENAMES)
    return aligned.select(*A.restore_headers(aligned, [*upload.columns, "Notes"], RENAMES))


@query("schema_align", ctes=("c360",), sql="SELECT customer_id, " + ", ".join(
    f"coalesce({f}, {catalog.DEFAULTS[f]!r}) AS {f}" if f in (
        "signup_year", "region", "customer_segment", "tenure_months", "contract_type", "monthly_spend_usd", "discount_pct",
        "support_tickets_90d", "nps_score", "days_since_last_activity", "orders_180d", "cart_abandon_rate",
        "avg_order_value_usd", "return_rate", "app_sessions_30d")
    else f"{catalog.DEFAULTS[f]!r} AS {f}" for f in catalog.SCHEMAS["ecommerce"]) + " FROM c360")
def schema_align(spark, base):
    return A.schema_align(C.feature_table(spark, base), "ecommerce", ["customer_id"])


@query("feature_types", ctes=("hdr", "cat"), sql="""
SELECT dataset_id, pos, cat.industry, feature, CASE WHEN role = 'text' THEN 'categorical' ELSE 'numeric' END AS kind
FROM hdr JOIN cat ON fclean = clean WHERE NOT (feature = 'tenure_months' AND industry IN ('saas', 'telecom'))""")
def feature_types(spark, base):
    return A.typed_headers(MT.with_clean(U.upload_headers(spark, base)))


def _untidy_banking(spark, base):
    return U.untidy_customers(spark, base).select(
        "id", F.col("num").alias("avg_balance_usd"), F.col("flag").alias("autopay_enabled"),
        F.col("joined").alias("signup_year"), (F.col("id") % 3).alias("churned"))


@query("validate_coerce", ctes=("dirty",), sql=f"""
SELECT avg_balance_usd, age, region, churned FROM (
  SELECT {NUM} AS avg_balance_usd, CAST(NULL AS DOUBLE) AS age, CAST(NULL AS VARCHAR) AS region, CAST(id % 3 AS INTEGER) AS churned FROM dirty)""")
def validate_coerce(spark, base):
    out = TypeCaster(numericCols=["avg_balance_usd"]).transform(A.validate(_untidy_banking(spark, base), "banking"))
    return out.select("avg_balance_usd", "age", "region", "churned")


@query("validation_violations", ctes=("dirty",), sql=f"""
SELECT id, 'num' AS "column", num AS value FROM dirty WHERE num IS NOT NULL AND {NUM} IS NULL
UNION ALL SELECT id, 'flag', flag FROM dirty WHERE flag IS NOT NULL AND try_cast(trim(flag) AS DOUBLE) IS NULL""")
def validation_violations(spark, base):
    return A.violations(U.untidy_customers(spark, base), ["num", "flag"], "id")


@query("target_violations", ctes=("dirty",), sql="""
SELECT id, label FROM dirty WHERE try_cast(trim(label) AS DOUBLE) IS NULL OR try_cast(trim(label) AS DOUBLE) NOT IN (0, 1)""")
def target_violations(spark, base):
    return A.target_violations(U.untidy_customers(spark, base).select("id", "label"), "label")


@query("idlike_columns", ctes=("hdr",), sql="""
SELECT dataset_id, pos, header FROM hdr WHERE regexp_matches(lower(header), 'id|name|email|phone|address|date')""")
def idlike_columns(spark, base):
    return U.upload_headers(spark, base).where(A.id_like(F.col("header")))


@query("clean_features", ctes=("dirty",), sql=f"""
SELECT id, {YEAR} AS signup_year, 'West' AS region, coalesce({NUM}, 5000.0::DOUBLE) AS avg_balance_usd, CAST({FLAG.format(d=0)} AS INTEGER) AS autopay_enabled,
  coalesce(try_cast(trunc({NUM}) AS INTEGER), 2) AS products_count, coalesce(nullif(trim(label), ''), 'checking') AS account_type, 40 AS age FROM dirty""")
def clean_features(spark, base):
    upload = U.untidy_customers(spark, base).select(
        "id", F.col("joined").alias("signup_year"), F.col("num").alias("avg_balance_usd"),
        F.col("flag").alias("autopay_enabled"), F.col("num").alias("products_count"), F.col("label").alias("account_type"))
    return A.clean_features(upload, "banking", ["id"]).select(
        "id", "signup_year", "region", "avg_balance_usd", "autopay_enabled", "products_count", "account_type", "age")


# --- joins --------------------------------------------------------------------
@query("join_answer_key", ctes=("c360",), sql="""
SELECT customer_id, industry, tenure_months, churned FROM c360 WHERE split = 'test' AND customer_id % 3 <> 0""")
def join_answer_key(spark, base):
    df = C.feature_table(spark, base).where(F.col("split") == "test")
    answers = df.where(F.col("customer_id") % 3 != 0).select("customer_id", "churned")
    return df.select("customer_id", "industry", "tenure_months").join(answers, "customer_id")


@query("positional_join", sql="""
SELECT o_orderkey, c_custkey, ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ordinal FROM orders)
JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS ordinal FROM customer) USING (ordinal)""")
def positional_join(spark, base):
    left = ordinal(TB.table(spark, base, "orders").select("o_orderkey"), "o_orderkey")
    right = ordinal(TB.table(spark, base, "customer").select("c_custkey"), "c_custkey")
    return left.join(right, "ordinal").select("o_orderkey", "c_custkey", "ordinal")


# --- overlap per upload ---------------------------------------------------------
define_cte("status", """
SELECT dataset_id, det.industry, cat.feature, fpos, m.feature IS NOT NULL AS mapped
FROM det JOIN cat USING (industry) LEFT JOIN mapping m USING (dataset_id, feature)""", "det", "cat", "mapping")
OVER = rnd("avg(CASE WHEN mapped THEN 1 ELSE 0 END) * 100", 1)
define_cte("overl", f"""
SELECT dataset_id, industry, count(CASE WHEN mapped THEN 1 END) AS mapped_features, count(CASE WHEN NOT mapped THEN 1 END) AS missing_features,
  {OVER} AS overlap_pct FROM status GROUP BY dataset_id, industry""", "status")


def upload_status(spark, base):
    def build(spark, base):
        h = U.upload_headers(spark, base)
        industries = materialize(MT.detect_industries(h), "industries")  # read twice below
        return A.feature_status(MT.column_mapping(h, industries), industries)
    return TB.stored(spark, base, "upload-status", ("part",), build)


@query("mapped_missing_features", ctes=("status",), sql="SELECT dataset_id, feature, mapped FROM status")
def mapped_missing_features(spark, base):
    return upload_status(spark, base).select("dataset_id", "feature", "mapped")


@query("schema_overlap", ctes=("overl",), sql="SELECT * FROM overl")
def schema_overlap(spark, base):
    return A.schema_overlap(upload_status(spark, base))


# The training tables know the customer features; an absent one with a numeric model and
# two mapped predictors is predicted, other known ones take the median or mode.
KNOWN = ("signup_year", "region", "customer_segment", "tenure_months", "contract_type", "monthly_spend_usd", "discount_pct",
         "support_tickets_90d", "nps_score", "days_since_last_activity")
KNOWN_TEXT = tuple(f for f in KNOWN if catalog.ROLES[f] == "text")
KNOWN_NUM = tuple(f for f in KNOWN if catalog.ROLES[f] != "text")


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


define_cte("prov", f"""
SELECT dataset_id, industry, feature, CASE WHEN feature IN {_in(KNOWN_NUM)} AND preds >= 2 THEN 'correlation' WHEN feature IN {_in(KNOWN_NUM)} THEN 'training_median'
  WHEN feature IN {_in(KNOWN_TEXT)} THEN 'training_mode' ELSE 'static_default' END AS source
FROM (SELECT *, sum(CASE WHEN mapped AND feature IN {_in(KNOWN_NUM)} THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id) AS preds FROM status) WHERE NOT mapped""", "status")


def provenance(spark, base):
    status = upload_status(spark, base)
    numeric = F.col("feature").isin(*KNOWN_NUM)
    preds = status.groupBy("dataset_id").agg(F.count(F.when(F.col("mapped") & numeric, 1)).alias("preds"))
    source = (
        F.when(numeric & (F.col("preds") >= 2), "correlation").when(numeric, "training_median")
        .when(F.col("feature").isin(*KNOWN_TEXT), "training_mode").otherwise("static_default"))
    return status.where(~F.col("mapped")).join(preds, "dataset_id").select(
        "dataset_id", "industry", "feature", source.alias("source"))


SOURCES = ("correlation", "training_median", "training_mode", "static_default")


def breakdown(spark, base):
    return provenance(spark, base).groupBy("dataset_id").pivot("source", list(SOURCES)).count().na.fill(0)


@query("imputation_breakdown", ctes=("prov",), sql="SELECT dataset_id, " + ", ".join(
    f"count(CASE WHEN source = '{s}' THEN 1 END) AS {s}" for s in SOURCES) + " FROM prov GROUP BY dataset_id")
def imputation_breakdown(spark, base):
    return breakdown(spark, base)


@query("quality_warnings", ctes=("overl", "prov"), sql=f"""
SELECT dataset_id, array_to_string(list_filter([
  CASE WHEN overlap_pct < 30 THEN 'Very low schema overlap (' || overlap_pct || '%). Predictions may be unreliable. Consider a dataset closer to the ' || industry || ' domain.' END,
  CASE WHEN overlap_pct >= 30 AND overlap_pct < 50 THEN 'Moderate schema overlap (' || overlap_pct || '%). ' || missing_features || ' features were statistically imputed.' END,
  CASE WHEN correlation > 0 THEN correlation || ' feature(s) were imputed using inter-feature correlations learned from the training data.' END,
  CASE WHEN static_default > 3 THEN static_default || ' feature(s) fell back to static defaults. This may reduce prediction accuracy.' END], lambda x: x IS NOT NULL), ' / ') AS warnings
FROM overl JOIN (SELECT dataset_id, count(CASE WHEN source = 'correlation' THEN 1 END) AS correlation, count(CASE WHEN source = 'static_default' THEN 1 END) AS static_default
  FROM prov GROUP BY dataset_id) USING (dataset_id)""")
def quality_warnings(spark, base):
    over = A.schema_overlap(upload_status(spark, base)).join(breakdown(spark, base), "dataset_id")
    text = A.quality_warnings(F.col("overlap_pct") / 100, F.col("overlap_pct"), F.col("missing_features"),
                              F.col("industry"), F.col("correlation"), F.col("static_default"))
    return over.select("dataset_id", F.array_join(text, " / ").alias("warnings"))


@query("proxy_gate", ctes=("c360",), sql="""
SELECT count(*) AS "rows", 3 AS numeric_columns, min(churned) <> max(churned) AS two_classes, 0.38::DOUBLE AS overlap,
  count(*) >= 50 AND min(churned) <> max(churned) AS train_proxy FROM c360""")
def proxy_gate(spark, base):
    df = C.feature_table(spark, base).select("customer_id", "tenure_months", "monthly_spend_usd", "orders_180d", "region", "churned")
    return A.proxy_gate(df, "churned", 0.38)


