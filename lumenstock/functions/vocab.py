"""Closed vocabularies. Order is meaningful: ordinals are positions, starting at 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
COMMERCIAL_STATUS = [
    "UNKNOWN", "ANNOUNCED", "DEVELOPMENT", "PROTOTYPE", "PILOT", "EARLY_ACCESS",
    "LIMITED_COMMERCIAL", "COMMERCIAL", "RAAS_DEPLOYMENT", "DISCONTINUED",
]
PORTFOLIO_STATUS = [
    "ANNOUNCED", "DEVELOPMENT", "PROTOTYPE", "PILOT", "EARLY_ACCESS",
    "LIMITED_COMMERCIAL", "COMMERCIAL", "RAAS_DEPLOYMENT",
]
TRANSACTION_TYPE = [
    "PURCHASE", "RENTAL", "SUBSCRIPTION", "LEASE", "RAAS", "PILOT", "DEVELOPER", "OTHER",
]
TRANSACTION_PREFERENCE = ["UNKNOWN", "RENT", "BUY", "LEASE", "RAAS", "FLEXIBLE"]
PRICE_TYPE = ["PUBLIC", "FROM", "ESTIMATED", "RANGE", "QUOTE_ONLY"]
BILLING_PERIOD = ["ONE_TIME", "HOURLY", "DAILY", "WEEKLY", "MONTHLY", "QUARTERLY", "ANNUAL"]
AVAILABILITY_STATUS = [
    "NOT_AVAILABLE", "WAITLIST", "PREORDER", "LIMITED", "AVAILABLE", "ON_REQUEST", "DISCONTINUED",
]
MOBILITY = ["BIPEDAL", "WHEELED", "HYBRID", "QUADRUPED", "STATIONARY", "OTHER"]
AUTONOMY = [
    "TELEOPERATED", "ASSISTED", "SUPERVISED_AUTONOMY", "TASK_AUTONOMOUS", "HIGHLY_AUTONOMOUS",
]
CONFIDENCE = ["LOW", "MEDIUM", "HIGH", "VERIFIED"]
CANDIDATE_TERMINAL = ["PROMOTED", "REJECTED"]
SORT_KEYS = ["name", "price", "payload", "newest"]
BUYER_TYPE = ["COMMERCIAL_BUYER", "TECHNICAL_EVALUATOR", "INDUSTRY_PARTICIPANT", "UNKNOWN"]

# Which transaction a stated preference asks for. Others accept any.
PREFERENCE_TO_TRANSACTION = {"RENT": "RENTAL", "BUY": "PURCHASE", "LEASE": "LEASE", "RAAS": "RAAS"}
# Availability statuses through which a buyer cannot engage.
NOT_ACCESSIBLE = ["NOT_AVAILABLE", "DISCONTINUED"]
# Price types that carry one comparable number.
POINT_PRICE_TYPES = ["PUBLIC", "FROM", "ESTIMATED"]
# Maturity score per commercial status; anything else scores 0.
MATURITY_SCORE = {
    "ANNOUNCED": 0.0, "DEVELOPMENT": 0.15, "PROTOTYPE": 0.30, "PILOT": 0.50,
    "EARLY_ACCESS": 0.65, "LIMITED_COMMERCIAL": 0.80, "COMMERCIAL": 1.0, "RAAS_DEPLOYMENT": 1.0,
}
# Criterion weights of the matcher.
WEIGHTS = {
    "use_case_fit": 25, "commercial_availability": 20, "technical_fit": 20,
    "geographic_fit": 15, "budget_fit": 10, "deployment_readiness": 10,
}


def ordinal(col: Column, values: list[str]) -> Column:
    """0-based position in a vocabulary; -1 when absent, NULL when the value is NULL."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), col).cast("int") - 1


def lookup(col: Column, mapping: dict, default) -> Column:
    """A closed mapping as one CASE expression."""
    out = None
    for key, value in mapping.items():
        cond = col == F.lit(key)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def transaction_for(preference: Column) -> Column:
    """Transaction type asked for by a preference; NULL means any."""
    return lookup(preference, PREFERENCE_TO_TRANSACTION, None)
