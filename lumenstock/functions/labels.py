"""Display labels: an absent value gets its own words, never a zero or a blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# Fixed values.
MODE_LABELS = {
    "PURCHASE": "Purchase", "RENTAL": "Rental", "SUBSCRIPTION": "Subscription", "LEASE": "Lease",
    "RAAS": "RaaS", "PILOT": "Pilot", "DEVELOPER": "Developer", "OTHER": "Other",
}
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "CNY": "¥"}
COUNTRY_NAMES = {
    "US": "United States", "CN": "China", "GB": "United Kingdom", "UK": "United Kingdom", "NO": "Norway",
    "DE": "Germany", "CA": "Canada", "JP": "Japan", "KR": "South Korea", "FR": "France",
    "CH": "Switzerland", "EU": "European Union", "APAC": "Asia-Pacific",
}
# Unit conversions.
CM_PER_INCH = 2.54
LB_PER_KG = 2.2046226218
MPH_PER_MS = 2.2369362921


def bool_label(flag: Column) -> Column:
    return F.when(flag, "YES").when(~flag, "NO").otherwise("UNKNOWN")


def money_label(amount: Column, currency: Column) -> Column:
    """Whole units with thousands separators after the currency's symbol, e.g. $13,500."""
    symbol = vocab.lookup(currency, CURRENCY_SYMBOLS, None)
    whole = F.format_number(F.round(amount, 0), 0)
    return F.concat(F.coalesce(symbol, F.concat(currency, F.lit(" "))), whole)


def short_money_label(amount: Column, currency: Column) -> Column:
    """$13k / $1.2m from 1,000 up; otherwise the full label."""
    symbol = F.coalesce(vocab.lookup(currency, CURRENCY_SYMBOLS, None), F.concat(currency, F.lit(" ")))

    def scaled(unit: int, suffix: str) -> Column:
        share = (amount / F.lit(unit)).cast("decimal(20,6)")
        text = F.when(share == F.floor(share), F.floor(share).cast("string")).otherwise(F.round(share, 1).cast("decimal(20,1)").cast("string"))
        return F.concat(symbol, text, F.lit(suffix))

    return F.when(amount >= 1_000_000, scaled(1_000_000, "m")).when(amount >= 1000, scaled(1000, "k")).otherwise(money_label(amount, currency))


def price_label(prefix: str = "") -> Column:
    """State of a product's headline price. No price row at all reads differently from a quote."""
    kind, cur = F.col(f"{prefix}price_type"), F.col(f"{prefix}currency")
    point = money_label(F.col(f"{prefix}price"), cur)
    span = F.concat(money_label(F.col(f"{prefix}price_min"), cur), F.lit(" – "), money_label(F.col(f"{prefix}price_max"), cur))
    return (
        F.when(kind.isNull(), "No confirmed pricing")
        .when(kind == "PUBLIC", F.coalesce(point, F.lit("—")))
        .when(kind == "FROM", F.coalesce(F.concat(F.lit("From "), point), F.lit("—")))
        .when(kind == "RANGE", F.coalesce(span, F.lit("—")))
        .when(kind == "ESTIMATED", F.coalesce(F.concat(F.lit("~"), point), F.lit("~—")))
        .when(kind == "QUOTE_ONLY", "Price on request")
        .otherwise(kind)
    )


def availability_label(modes: Column) -> Column:
    return F.when(F.size(modes) > 0, "AVAILABLE").otherwise("AVAILABILITY UNKNOWN")


def mode_labels(modes: Column) -> Column:
    return F.transform(modes, lambda m: F.coalesce(vocab.lookup(m, MODE_LABELS, None), m))


def date_label(day: Column) -> Column:
    """24 JUL 2026."""
    return F.upper(F.date_format(day, "dd MMM yyyy"))


def region_label(code: Column) -> Column:
    name = vocab.lookup(F.upper(code), COUNTRY_NAMES, None)
    return F.when(name.isNotNull(), F.concat(F.upper(name), F.lit(" / "), F.upper(code))).otherwise(F.upper(code))


def feet_inches(cm: Column) -> Column:
    inches = F.floor(cm.cast("double") / F.lit(CM_PER_INCH) + F.lit(0.5)).cast("long")
    return F.concat_ws(" ", F.floor(inches / 12).cast("string"), F.lit("ft"), (inches % 12).cast("string"), F.lit("in"))


def pounds(kg: Column) -> Column:
    whole = F.floor(kg.cast("double") * F.lit(LB_PER_KG) + F.lit(0.5)).cast("long")
    return F.concat(whole.cast("string"), F.lit(" lb"))


def miles_per_hour(ms: Column) -> Column:
    tenths = F.floor(ms.cast("double") * F.lit(MPH_PER_MS) * F.lit(10.0) + F.lit(0.5)).cast("long")
    whole, rest = F.floor(tenths / 10).cast("string"), tenths % 10
    return F.concat(F.when(rest == 0, whole).otherwise(F.concat_ws(".", whole, rest.cast("string"))), F.lit(" mph"))
