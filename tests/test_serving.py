import json

import pytest
from pyspark.sql import functions as F

from tidemark import api
from tidemark.operators import lifecycle as L
from tidemark.operators.bridge import FeatureBridge
from tidemark.operators.preprocess import Preprocessor
from tidemark.operators.serving import score_upload
from tidemark.operators.splitting import kfold, stratified_split
from tidemark.plans.scoring_queries import ecommerce_risk, reference_rows
from tidemark.sources import tables as TB


def test_single_record_goes_through_the_batch_operators(spark, base):
    payload = {"Tenure": "3", "Contract": "month_to_month", "nps_score": "2", "Recency": "400", "Orders": "0",
               "cart_abandon_rate": "0.9"}
    row = api.predict_record(
        json.dumps(payload), "ecommerce", reference_rows(spark, base, "train"), reference_rows(spark, base, "val"),
        ecommerce_risk, ", ".join(f"{k} string" for k in payload)).first()
    assert row.prediction in ("Yes", "No") and len(row.sources) == 3
    assert row.impact > 0 and any("Short-term Contract" in d for d in row.drivers)
    assert any("NPS score (2)" in d for d in row.drivers)


def test_train_industry_end_to_end(spark, tmp_path):
    rows = [(i, i % 48 + 1, 50 + (i * 37 % 997) / 10, "annual" if i % 3 else "month_to_month", i % 2,
             int((i * 7919) % 100 < (80 if i % 48 < 20 else 15))) for i in range(900)]
    df = spark.createDataFrame(rows, "customer_id bigint, tenure_months int, monthly_spend_usd double, "
                                     "contract_type string, autopay_enabled int, churned int")
    split = F.col("customer_id") % 3
    space = {"maxIter": [6], "maxDepth": [4], "stepSize": [0.1], "subsamplingRate": [1.0], "numTrees": [12]}
    out = api.train_industry("retail", df.where(split == 0), df.where(split == 1), df.where(split == 2), "customer_id",
                             trials=1, folds=2, space=space, path=str(tmp_path / "retail"))
    assert out.coverage.count() == 4 and out.trials[0]["auc"] > 0.6
    assert {r.industry for r in out.evaluation.collect()} == {"retail", "Mean"}
    assert spark.read.parquet(str(tmp_path / "retail" / "quantiles")).count() == 4


def test_uploads_with_text_ids_and_without_ids(spark, base):
    columns = "Tenure string, Contract string, Recency string, Orders string"
    rows = [("3", "month_to_month", "400", "0"), ("40", "annual", "Infinity", "3000000000"), (None, "x7", "", "7")]
    references = reference_rows(spark, base, "train"), reference_rows(spark, base, "val"), ecommerce_risk
    named = spark.createDataFrame([(f"{i}-VHVEG", *r) for i, r in enumerate(rows)], "customerID string, " + columns)
    out = score_upload(named, *references, bridge=FeatureBridge("ecommerce"))[1].collect()
    assert {r.customer_id for r in out} == {f"{i}-VHVEG" for i in range(3)} and all(len(r.sources) == 3 for r in out)
    plain = score_upload(spark.createDataFrame(rows, columns), *references, bridge=FeatureBridge("ecommerce"))[1]
    assert plain.count() == 3 and sorted(r.p_final for r in plain.collect()) == sorted(r.p_final for r in out)


def test_keys_of_any_kind_split_and_fold(spark):
    df = spark.createDataFrame([(str(k), i % 2) for i, k in enumerate([4_000_000_000, -7, 2 ** 62, "7590-VHVEG", "x", 5, 6, 8, 9, 10] * 3)],
                               "key string, churned int").distinct()
    for rows in (df, df.where("key rlike '^-?[0-9]+$'").withColumn("key", F.col("key").cast("bigint"))):
        assert stratified_split(rows, "key", "churned").groupBy("part").count().count() == 2
        assert kfold(rows, "key", "churned", 3).count() == rows.count()


def test_broken_numbers_do_not_stop_training(spark):
    df = spark.createDataFrame([("1", "a"), ("x7", None), ("3", "a"), ("Infinity", "b")], "num string, cat string")
    model = Preprocessor(numericCols=["num"], categoricalCols=["cat"]).fit(df)
    assert [round(r.num, 3) for r in model.transform(df).collect()] == [-1.414, 0.0, 1.414, 0.0]


def test_ingest_needs_a_target(spark):
    with pytest.raises(ValueError):
        L.ingest(spark.createDataFrame([(1, 2)], "key bigint, tenure int"), "retail", "key")


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        TB.read_csv(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "a.csv").write_text("id,x,note\n1,NaN,\n2,3.5,ok\n")
    df = TB.read_csv(spark, str(tmp_path / "a.csv"), spark.createDataFrame([], "id int, x double, note string").schema)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, None), (2, 3.5, "ok")]
    got = TB.first_available(spark, [("csv", str(tmp_path / "none.csv")), ("csv", str(tmp_path / "a.csv"))])
    assert got.columns == ["id", "x", "note"]
    (tmp_path / "broken.parquet").write_text("this is no such file")

    def refuse(df):
        raise ValueError("no target column")

    broken = ("parquet", str(tmp_path / "broken.parquet"))
    assert TB.first_available(spark, [broken, ("csv", str(tmp_path / "a.csv"))]).columns == ["id", "x", "note"]
    with pytest.raises(FileNotFoundError, match="no target column"):
        TB.first_available(spark, [broken, ("csv", str(tmp_path / "a.csv"))], refuse)
    assert TB.resolve_data_dir(spark, [str(tmp_path / "none"), str(tmp_path)], env="TIDEMARK_UNSET") == str(tmp_path)
