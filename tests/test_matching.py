import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import align as A
from tidemark.operators import matcher as MT
from tidemark.operators.bridge import FeatureBridge
from tidemark.operators.models import train_proxy
from tidemark.sources.uploads import HEADER_LISTS


def brute_force(headers, corpus, features):
    """All cosine similarities of one upload, straight from the definition."""
    docs = [*catalog.corpus_documents(corpus), *[catalog.clean(h) for h in headers]]
    df = Counter(g for d in docs for g in set(catalog.char_ngrams(d)))

    def vec(text):
        v = {g: n * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in Counter(catalog.char_ngrams(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / norm for g, x in v.items()}

    known = {(f, catalog.clean(a)) for f, a in catalog.lexicon()}
    out = {}
    for i, h in enumerate(headers):
        c = catalog.clean(h)
        for f in features:
            if c == catalog.clean(f):
                out[i, f] = 1.0
            elif (f, c) in known:
                out[i, f] = 0.95
            else:
                a, b = vec(c), vec(catalog.clean(f))
                out[i, f] = sum(x * b.get(g, 0.0) for g, x in a.items())
    return out


HEADERS = ["Tenure Months", "montly_spend", "aov", "plan type", "Tenure Months Total", "zzz", "x"]


@pytest.mark.parametrize("corpus", ["detect", "telecom"])
def test_similarity_equals_definition(spark, corpus):
    h = MT.with_clean(MT.header_frame(spark, HEADERS)).withColumns({"corpus": F.lit(corpus), "wanted": F.lit(True)})
    features = list(catalog.FEATURES) if corpus == "detect" else catalog.SCHEMAS[corpus]
    want = brute_force(HEADERS, corpus, features)
    got = {(r.pos, r.feature): r.similarity for r in MT.similarities(h, (corpus,)).collect()}
    for key, value in want.items():
        assert got.get(key, 0.0) == pytest.approx(value, abs=2e-9)


@pytest.mark.parametrize("name,industry", [("telco", "telecom"), ("bank", "banking"), ("shop", "ecommerce")])
def test_public_header_lists(spark, name, industry):
    headers = HEADER_LISTS[name].split()
    assert MT.detect_industry(spark, headers) == industry
    mapping = MT.map_columns(spark, headers, industry)
    assert mapping[headers[0] if name != "bank" else "CustomerId"] == "customer_id"
    if name == "shop":
        assert mapping["CashbackAmount"] == "monthly_spend_usd" and mapping["OrderCount"] == "orders_180d"
    assert len(set(mapping.values())) == len(mapping)


def test_identifier_only_tables_fall_back(spark):
    assert MT.detect_industry(spark, ["id", "Customer_ID", "surname"]) == catalog.FALLBACK_INDUSTRY


def test_exact_name_beats_earlier_synonym(spark):
    mapping = MT.map_columns(spark, ["tenure", "Tenure_Months", "id"], "retail")
    assert mapping == {"Tenure_Months": "tenure_months", "id": "customer_id"}


def test_bridge_imputes_and_trains_a_proxy(spark):
    rows = [(i, i % 50, float(i % 7), float(i % 11), "Yes" if i % 7 > 3 else "No") for i in range(120)]
    df = spark.createDataFrame(rows, "key bigint, Tenure int, WarehouseDistance double, Gadgets double, Churn string")
    training = spark.createDataFrame(
        [(i % 60, 10.0 * (i % 60), i % 5, "annual") for i in range(100)],
        "tenure_months int, monthly_spend_usd double, nps_score int, contract_type string")
    out = FeatureBridge("ecommerce", training, proxy=lambda *a: train_proxy(*a, iterations=3)).transform(df, ("key",))
    assert out.df.columns[:1] == ["key"] and out.df.columns[-21:] == catalog.SCHEMAS["ecommerce"]
    assert out.sources["contract_type"] == "training_mode" and out.sources["monthly_spend_usd"] == "training_median"
    report = out.report.first()
    assert report.mapped_features_count == 1 and report.proxy_model.used and report.proxy_model.auc > 0.9
    assert any("Very low schema overlap (4.8%)" in w for w in report.data_quality_warnings)
    assert out.df.where("proxy_probability between 0 and 1 and churned in (0, 1)").count() == 120


def test_validation(spark):
    df = spark.createDataFrame([("7", "x", 0), ("8", "2", 2)], "customer_id string, age string, churned int")
    out = A.validate(df.withColumn("age", F.col("age").try_cast("double")), "retail")
    assert "customer_id" not in out.columns and set(catalog.SCHEMAS["retail"]) <= set(out.columns)
    with pytest.raises(A.SchemaValidationError):
        A.require_valid_target(df)
    assert A.id_like_names(["paid_amount", "Phone", "tenure"]) == ["paid_amount", "Phone"]
    whole = spark.createDataFrame([("paid_amount",), ("user_id",)], "n string").where(A.id_like(F.col("n"), True))
    assert [r.n for r in whole.collect()] == ["user_id"]


def shuffled_by(df):
    """The key lists of all shuffles by upload in a frame's plan; those of the lexicon have a fixed size."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = [re.sub(r"#\w+", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]
    return [k for k in keys if "dataset_id" in k]


def upload_rows(spark):
    """Two uploads of unlike width, repeated and missing keys and names, and a header that is not matched."""
    names = [*HEADERS, *HEADERS[:3], None, "", "status", "tenure", "region"]
    rows = [(1, i % 9, n) for i, n in enumerate(names)] + [(2, i, n) for i, n in enumerate(HEADERS[:4])]
    rows += [(None, 1, "tenure"), (2, None, "plan type"), (2, 9, "id")]
    return MT.with_clean(spark.createDataFrame(rows, "dataset_id bigint, pos int, header string"))


@pytest.mark.parametrize("corpora", [("detect",), catalog.INDUSTRIES])
def test_wide_uploads_come_apart_with_the_same_similarities(spark, monkeypatch, corpora):
    h = upload_rows(spark).withColumns({"corpus": F.lit(corpora[0]), "wanted": F.col("clean") != "id"})

    def found():
        return sorted((repr(tuple(r)) for r in MT.similarities(h, corpora).collect()))

    whole = found()
    monkeypatch.setattr(MT, "WIDE", 5)
    assert [wide for _, wide in MT.by_upload(h)] == [False, True]
    assert found() == whole and len(whole) > 20


def test_headers_are_shuffled_once_before_their_grams(spark):
    h = upload_rows(spark)
    sims = MT.similarities(MT.detection_headers(h.drop("clean")), ("detect",))
    assert shuffled_by(sims) == ["dataset_id"]
    assert shuffled_by(MT.best_matches(h.drop("clean"))) == ["dataset_id"]


def test_tfidf_is_dealt_out_by_upload_and_equals_definition(spark, monkeypatch):
    names = [catalog.clean(n) for n in HEADERS]
    df = Counter(g for n in names for g in set(catalog.char_ngrams(n)))
    want = {}
    for i, n in enumerate(names):
        v = {g: c * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g, c in Counter(catalog.char_ngrams(n)).items()}
        want |= {(i, g): x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()}
    h = MT.with_clean(MT.header_frame(spark, HEADERS))
    assert shuffled_by(MT.tfidf(h)) == ["dataset_id"]
    with monkeypatch.context() as small:
        small.setattr(MT, "TASK_HEADERS", 1)
        assert MT.tfidf(h).rdd.getNumPartitions() >= len(HEADERS)
    for width in (MT.WIDE, 3):
        monkeypatch.setattr(MT, "WIDE", width)
        assert {(r.pos, r.gram): r.weight for r in MT.tfidf(h).collect()} == pytest.approx(want)
