"""Small rules shared by many operators, each one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def accessible(status: Column) -> Column:
    """A buyer can engage through an offer of this availability status."""
    return ~status.isin(vocab.NOT_ACCESSIBLE)


def comparable_amount(df_prefix: str = "") -> Column:
    """Number a price can be compared by: point price, upper bound of a range, else NULL."""
    kind = F.col(f"{df_prefix}price_type")
    return (
        F.when(kind.isin(vocab.POINT_PRICE_TYPES), F.col(f"{df_prefix}price"))
        .when(kind == "RANGE", F.col(f"{df_prefix}price_max"))
    )


def display_eligible() -> Column:
    """An image may be shown: identity verified, rights suffice, owed credit is given."""
    rights = F.col("rights_status")
    licensed = rights.isin("PERMITTED", "ATTRIBUTION_REQUIRED")
    official = F.col("usage_basis") == "OFFICIAL_MANUFACTURER_MEDIA"
    credited = (rights != "ATTRIBUTION_REQUIRED") | (F.trim(F.coalesce("attribution", F.lit(""))) != "")
    return (F.col("identity_status") == "VERIFIED") & (rights != "RESTRICTED") & (licensed | official) & credited


def radar_eligible() -> Column:
    """A discovery source may be crawled."""
    return (
        F.col("is_enabled")
        & (F.col("tos_status") == "ALLOWED")
        & F.col("robots_status").isin("ALLOWED", "NOT_APPLICABLE")
        & F.col("reviewed_at").isNotNull()
        & F.col("reviewed_by").isNotNull()
    )


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def budget_ramp(price: Column, budget: Column) -> Column:
    """1 within budget, falling linearly to 0 at 110 % of it."""
    ceiling = F.lit(1.1) * budget
    return (
        F.when(price <= budget, F.lit(1.0))
        .when(price >= ceiling, F.lit(0.0))
        .otherwise((ceiling - price) / (F.lit(0.1) * budget))
    )


def payload_headroom(payload: Column, minimum: Column) -> Column:
    """Share of 125 % of the required payload that the product carries."""
    return F.when(minimum == 0, F.lit(1.0)).otherwise(clamp01(payload / (minimum * F.lit(1.25))))
