"""Uploaded tables derived from the given ones: header lists and untidy values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import stored, table

# Column headers of four public churn data sets.
HEADER_LISTS = {
    "telco": "customerID gender SeniorCitizen Partner Dependents tenure PhoneService MultipleLines "
             "InternetService OnlineSecurity OnlineBackup DeviceProtection TechSupport StreamingTV "
             "StreamingMovies Contract PaperlessBilling PaymentMethod MonthlyCharges TotalCharges Churn",
    "bank": "RowNumber CustomerId Surname CreditScore Geography Gender Age Tenure Balance "
            "NumOfProducts HasCrCard IsActiveMember EstimatedSalary Exited",
    "subscription": "user_id signup_date last_login_days_ago payment_failures avg_weekly_usage_hours "
                    "support_tickets plan_type monthly_fee active_users integrations churned",
    "shop": "CustomerID Churn Tenure PreferredLoginDevice CityTier WarehouseToHome PreferredPaymentMode "
            "Gender HourSpendOnApp NumberOfDeviceRegistered SatisfactionScore MaritalStatus Complain "
            "OrderAmountHikeFromlastYear CouponUsed OrderCount DaySinceLastOrder CashbackAmount",
    "ids": "id customer_id user_id account_id RowNumber Surname",
}
LABEL_SPELLINGS = ("Yes", "No", "yes", "YES", "True", "false", "1", "0", "Existing Customer",
                   "Attrited Customer", "Exited", "retained", " ", None, "maybe", "churned")
FLAG_SPELLINGS = ("yes", "No", "TRUE", "0", "onboarded", "Disabled", "1.0", "2", " enabled ", None, "maybe")
COLUMNS_PER_UPLOAD = 20


def pick(words: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("string") for w in words]), (index + 1).cast("int"))


def upload_headers(spark: SparkSession, base: str) -> DataFrame:
    """The header table of all uploads, stored once like any landed metadata."""
    return stored(spark, base, "headers", ("part",), landed_headers)


def landed_headers(spark: SparkSession, base: str) -> DataFrame:
    """(dataset_id, pos, header): one header per part, twenty parts to an uploaded table.

    The spelling follows the part's size: as listed, upper or lower case, with an
    underscore, padded, or with a letter missing; some headers are the part's own name.
    """
    key = F.col("p_partkey")
    df = table(spark, base, "part").select(
        F.floor(key / COLUMNS_PER_UPLOAD).alias("dataset_id"),
        (key % COLUMNS_PER_UPLOAD).cast("int").alias("pos"), "p_name", "p_size")
    lists = {k: tuple(v.split()) for k, v in HEADER_LISTS.items()}
    d, pos = F.col("dataset_id"), F.col("pos")
    listed = pick(lists["ids"], (pos + d) % len(lists["ids"]))
    for i, name in enumerate(("telco", "bank", "subscription", "shop")):
        words = lists[name]
        listed = F.when((d % 4 == i) & (d % 50 != 49), pick(words, (pos + d) % len(words))).otherwise(listed)
    style = F.col("p_size") % 6
    spelled = (
        F.when(style == 1, F.upper(listed)).when(style == 2, F.lower(listed))
        .when(style == 3, F.concat(listed, F.lit("_"))).when(style == 4, F.concat(F.lit(" "), listed, F.lit(" ")))
        .when(style == 5, F.concat(F.substring(listed, 1, 1), F.substring(listed, 3, 100))).otherwise(listed)
    )
    noise = (F.col("p_size") % 10 == 9) & (d % 50 != 49)
    return df.select("dataset_id", "pos", F.when(noise, F.col("p_name")).otherwise(spelled).alias("header"))


def untidy_customers(spark: SparkSession, base: str) -> DataFrame:
    """(id, num, flag, joined, label): every value as text, the way uploads arrive."""
    key = F.col("c_custkey")
    amount = F.col("c_acctbal").cast("string")
    day = F.concat_ws("-", (F.lit(1990) + key % 35).cast("string"),
                      F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))
    year = (F.lit(1990) + key % 35).cast("string")
    num = (
        F.when(key % 10 == 0, F.lit("  ")).when(key % 10 == 1, F.concat(F.lit(" "), amount, F.lit(" ")))
        .when(key % 10 == 2, F.concat(F.lit("x"), amount)).when(key % 10 == 3, F.lit(None))
        .when(key % 50 == 4, F.lit("Infinity")).when(key % 50 == 5, F.lit("3000000000")).otherwise(amount)
    )
    joined = (
        F.when(key % 6 == 0, day).when(key % 6 == 1, year).when(key % 6 == 2, F.concat(year, F.lit(".0")))
        .when(key % 6 == 3, F.lit("abc")).when(key % 6 == 4, F.lit(None)).otherwise(F.lit("5"))
    )
    return table(spark, base, "customer").select(
        key.alias("id"), num.alias("num"), pick(FLAG_SPELLINGS, key % len(FLAG_SPELLINGS)).alias("flag"),
        joined.alias("joined"), pick(LABEL_SPELLINGS, key % len(LABEL_SPELLINGS)).alias("label"))
