"""Scalar functions as native Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import catalog


#: Bits of ``portable_hash``; a double holds them exactly.
HASH_BITS = 52
INT32 = (-(2.0 ** 31), 2.0 ** 31 - 1)


def stable_round(x: Column, digits: int) -> Column:
    """Half-up rounding as ``floor(x * 10^d + 0.5) / 10^d`` in plain IEEE arithmetic.

    Other engines reproduce it bit for bit, which ``round`` on doubles does not
    guarantee.
    """
    scale = float(10 ** digits)
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clean_name(x: Column) -> Column:
    """Trim, lower-case and drop underscores and blanks."""
    return F.translate(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), "_ ", "")


def char_ngrams(x: Column, lo: int = 2, hi: int = 4) -> Column:
    """All character n-grams for n in lo..hi, shorter ones first."""
    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(x) - (n - 1))
        grams = F.transform(starts, lambda i: F.substring(x, i, n))
        return F.when(F.length(x) >= n, grams).otherwise(F.array().cast("array<string>"))

    parts = [of_length(n) for n in range(lo, hi + 1)]
    return F.concat(*parts)


def blank_to_null(x: Column) -> Column:
    return F.when(~x.rlike(r"^\s*$"), x)


def to_number(x: Column) -> Column:
    """Numeric coercion: anything that is not a finite number becomes NULL."""
    text = F.trim(x.cast("string"))
    number = text.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite & ~text.rlike("[dDfF]$"), number)


def to_int(number: Column) -> Column:
    """A double cut to a whole number; NULL beyond 32 bits, never an error."""
    return F.when(number.between(*INT32), number).try_cast("int")


def coerce_numeric(x: Column, default: float | None) -> Column:
    return F.coalesce(to_number(x), F.lit(None if default is None else float(default)))


def lookup(x: Column, words: Mapping[int, Iterable[str]]) -> Column:
    """Value dictionary as a CASE expression; unknown values give NULL."""
    out = F.lit(None).cast("int")
    for value, spellings in words.items():
        out = F.when(x.isin(*spellings), F.lit(value)).otherwise(out)
    return out


def map_target_values(x: Column, vocabulary: str = "ingest", unmapped: str = "zero") -> Column:
    """Label spellings to 0/1; ``unmapped`` is ``zero`` (0) or ``drop`` (NULL)."""
    words = {"ingest": catalog.LABELS_INGEST, "augment": catalog.LABELS_AUGMENT}[vocabulary]
    mapped = lookup(x, words)
    number = to_number(x)
    mapped = F.coalesce(mapped, F.when(number.isin(0.0, 1.0), number.cast("int")))
    if unmapped not in ("zero", "drop"):
        raise ValueError(f"unmapped must be 'zero' or 'drop', not {unmapped!r}")
    return F.coalesce(mapped, F.lit(0)) if unmapped == "zero" else mapped


def parse_binary(x: Column, default: int = 0) -> Column:
    """Flag words, else the truncated number, else the default."""
    text = F.lower(F.trim(x.cast("string")))
    return F.coalesce(lookup(text, catalog.FLAG_WORDS), to_int(to_number(x)), F.lit(int(default)))


def cast_training_flag(x: Column) -> Column:
    """Flag words of the training data; anything else is 0."""
    text = F.lower(F.trim(x.cast("string")))
    return F.coalesce(lookup(text, catalog.TRAINING_FLAG_WORDS), F.lit(0))


def extract_year(x: Column, default: int = 2024) -> Column:
    """Year of a date string, or a number between 1900 and 2100 taken as a year."""
    number = to_number(x)
    return F.coalesce(
        F.when(number.between(1900, 2100), number.cast("int")),
        F.when(number.isNull(), F.year(F.try_to_timestamp(F.trim(x.cast("string"))))),
        F.lit(default),
    )


def similarity_pct(distance: Column) -> Column:
    return F.lit(100.0) / (F.lit(1.0) + distance)


def level_from_text(x: Column) -> Column:
    """Confidence level in percent; anything but a calibrated level means 85."""
    pct = to_int(F.rint(to_number(x) * 100))
    return F.when(pct.isin(*catalog.LEVELS_PCT), pct).otherwise(F.lit(catalog.DEFAULT_LEVEL_PCT))


def action_tier(in0: Column, in1: Column) -> Column:
    return (
        F.when(in0 & in1, "Active Monitoring")
        .when(in1, "Action Required")
        .when(in0, "No Intervention")
        .otherwise("Active Monitoring (Uncertain Profile)")
    )


def set_label(in0: Column, in1: Column) -> Column:
    """The prediction set as text; an empty set shows both labels."""
    return F.when(in1 & ~in0, "Churned").when(in0 & ~in1, "Retained").otherwise("Retained, Churned")


def suggested_action(tier: Column) -> Column:
    return (
        F.when(tier == "Action Required", "Suggested Action: Trigger high-value outreach.")
        .when(tier.startswith("Active Monitoring"), "Suggested Action: Deploy success check-in.")
        .otherwise("Suggested Action: No intervention budget spent.")
    )


def blend_proxy(main: Column, proxy: Column, overlap: Column) -> Column:
    """Weight the main model by schema overlap, clipped to 0.3..0.9."""
    alpha = F.least(F.greatest(overlap, F.lit(0.3)), F.lit(0.9))
    blended = F.least(F.greatest(alpha * main + (1 - alpha) * proxy, F.lit(0.0)), F.lit(1.0))
    return F.when(proxy.isNull(), main).otherwise(blended)


def blend_retrieval(p: Column, p_retrieval: Column) -> Column:
    blended = F.lit(catalog.MODEL_WEIGHT) * p + F.lit(catalog.RETRIEVAL_WEIGHT) * p_retrieval
    return F.when(p_retrieval.isNull(), p).otherwise(blended)


def drift_status(ood_pct: Column) -> Column:
    return (
        F.when(ood_pct > catalog.DRIFT_WARNING_PCT, "Drift Warning")
        .when(ood_pct > catalog.DRIFT_CAUTION_PCT, "Caution")
        .otherwise("Safe")
    )


def route_by_filename(name: Column) -> Column:
    """Which training split a labelled file extends."""
    low = F.lower(name)
    return (
        F.when(low.contains("train"), "Train Set")
        .when(low.rlike("val|calib"), "Validation Set")
        .otherwise("Split Train/Val (80/20)")
    )


def portable_hash(key: Column) -> Column:
    """A number below ``2 ** HASH_BITS`` from the text of any key, identical in every engine.

    Keys of any type and size qualify, text and negative ones too; a null key counts as empty text.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def risk_drivers(industry: Column, c: Mapping[str, Column]) -> Column:
    """Plain-language risk drivers of a record, as an array of strings."""
    def text(x: Column) -> Column:
        return to_int(x.cast("double")).cast("string")

    rules = [
        F.when(c["contract_type"] == "month_to_month",
               F.lit("Short-term Contract (Month-to-month) increases risk of early churn.")),
        F.when(c["support_tickets_90d"] > 5,
               F.concat(F.lit("High support ticket volume ("), text(c["support_tickets_90d"]),
                        F.lit(" in last 90 days) indicates technical frustration."))),
        F.when(c["nps_score"] < 7,
               F.concat(F.lit("Low Customer NPS score ("), text(c["nps_score"]),
                        F.lit(") indicates dissatisfaction or negative sentiment."))),
        F.when((industry == "telecom") & (c["dropped_calls_30d"] > 5),
               F.concat(F.lit("High dropped call frequency ("), text(c["dropped_calls_30d"]),
                        F.lit(" in 30 days) signals signal/coverage issues."))),
        F.when((industry == "saas") & (c["feature_adoption_score"] < 0.5),
               F.concat(F.lit("Low feature adoption ("), text(stable_round(c["feature_adoption_score"] * 100, 0)),
                        F.lit("%) shows low product utilization."))),
        F.when((industry == "retail") & (c["days_since_last_activity"] > 45),
               F.concat(F.lit("High inactivity period ("), text(c["days_since_last_activity"]),
                        F.lit(" days) suggests customer is slipping away."))),
        F.when((industry == "banking") & (c["overdrafts_12m"] > 1),
               F.concat(F.lit("Customer has "), text(c["overdrafts_12m"]),
                        F.lit(" overdrafts in last 12 months, indicating financial stress."))),
    ]
    found = F.array_compact(F.array(*rules))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Mostly low-risk features selected.")))


def evidence_detail(industry: Column, c: Mapping[str, Column]) -> Column:
    """One line about a neighbour, per industry."""
    def whole(x: Column) -> Column:
        return to_int(x.cast("double")).cast("string")

    forms = {
        "telecom": ("Plan: ", c["plan_type"], " | Data: ", c["data_usage_gb_30d"].cast("string"), " GB"),
        "saas": ("Seats: ", whole(c["seats_purchased"]), " | Feature score: ",
                 c["feature_adoption_score"].cast("string")),
        "retail": ("Tier: ", c["loyalty_tier"], " | Basket: $", c["avg_basket_usd"].cast("string")),
        "banking": ("Account: ", c["account_type"], " | Balance: $", c["avg_balance_usd"].cast("string")),
        "ecommerce": ("Orders: ", whole(c["orders_180d"]), " | Cart Abandon: ",
                      c["cart_abandon_rate"].cast("string")),
        "education": ("Courses: ", whole(c["courses_enrolled"]), " | Completion: ",
                      c["completion_rate"].cast("string")),
        "healthcare": ("Plan: ", c["plan_category"], " | Appts: ", whole(c["appointments_12m"])),
        "hospitality": ("Level: ", c["membership_level"], " | Stays: ", whole(c["stays_12m"])),
        "insurance": ("Policy: ", c["policy_type"], " | Policies: ", whole(c["policy_count"])),
        "utilities": ("Service: ", c["service_type"], " | Smart Meter: ", whole(c["smart_meter_enabled"])),
    }
    out = F.concat(F.lit("Spend: $"), c["monthly_spend_usd"].cast("string"))
    for name, parts in forms.items():
        line = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        out = F.when(industry == name, line).otherwise(out)
    return out
