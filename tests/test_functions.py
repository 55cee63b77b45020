import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars as S


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_catalog_sizes():
    assert len(catalog.lexicon()) == 358
    assert len(catalog.FEATURES) == 75 and all(len(s) == 21 for s in catalog.SCHEMAS.values())


def test_clean_name_ignores_case_blanks_and_underscores(spark):
    got = column(spark, ["Tenure Months", "tenure_months", " TENUREMONTHS ", "\ttenure_Months"], S.clean_name)
    assert set(got) == {"tenuremonths"}


def test_char_ngrams(spark):
    assert column(spark, ["abc", "a", "abcde"], S.char_ngrams) == [catalog.char_ngrams(t) for t in ("abc", "a", "abcde")]


def test_labels(spark):
    values = ["Yes", "No", "YES", "True", "1", "Attrited Customer", "Existing Customer", "maybe", None, "Exited", "retained"]
    assert column(spark, values, S.map_target_values) == [1, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0]
    got = column(spark, values, lambda x: S.map_target_values(x, "augment", "drop"))
    assert got == [1, 0, None, 1, 1, None, None, None, None, 1, 0]


def test_numbers_flags_and_years(spark):
    assert column(spark, [" 12 ", "x", " ", None, "NaN", "1e2", "12d"], lambda x: S.coerce_numeric(x, 7.0)) == [
        12.0, 7.0, 7.0, 7.0, 7.0, 100.0, 7.0]
    assert column(spark, ["onboarded", "Disabled", "1.0", "2", None, "?"], lambda x: S.parse_binary(x, 1)) == [1, 0, 1, 2, 1, 1]
    assert column(spark, ["2021-03-04", "2021", "2021.0", "abc", None], S.extract_year) == [2021, 2021, 2021, 2024, 2024]


def test_rounding_and_levels(spark):
    assert column(spark, [2.345, -1.005, 0.5], lambda x: S.stable_round(x, 0), "double") == [2.0, -1.0, 1.0]
    assert column(spark, ["0.90", "0.8", "0.77", "high", None], S.level_from_text) == [90, 80, 85, 85, 85]


@pytest.mark.parametrize("in0,in1,tier", [
    (True, True, "Active Monitoring"), (False, True, "Action Required"), (True, False, "No Intervention"),
    (False, False, "Active Monitoring (Uncertain Profile)")])
def test_action_tier(spark, in0, in1, tier):
    assert spark.range(1).select(S.action_tier(F.lit(in0), F.lit(in1)).alias("t")).first().t == tier


def test_blend_and_drift(spark):
    row = spark.range(1).select(
        S.blend_proxy(F.lit(0.5), F.lit(1.0), F.lit(0.1)).alias("a"), S.blend_proxy(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.1)).alias("b"),
        S.blend_retrieval(F.lit(0.5), F.lit(1.0)).alias("c"), S.drift_status(F.lit(30.0)).alias("d"),
        S.drift_status(F.lit(30.1)).alias("e"), S.drift_status(F.lit(15.0)).alias("f")).first()
    assert row.a == pytest.approx(0.85) and row.b == 0.5 and row.c == pytest.approx(0.6)
    assert (row.d, row.e, row.f) == ("Caution", "Drift Warning", "Safe")
