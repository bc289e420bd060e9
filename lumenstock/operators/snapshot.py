"""Aggregates over the catalogue: commercial and market snapshots, maker and use-case coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.rules import accessible


def commercial_snapshot(products: DataFrame, availability: DataFrame, deployments: DataFrame) -> DataFrame:
    """Maturity, obtainability and deployment evidence of each product as independent columns."""
    offers = (
        availability.filter(F.col("is_current") & accessible(F.col("availability_status")))
        .groupBy(F.col("product_id").alias("id"))
        .agg(F.array_sort(F.collect_set("transaction_type")).alias("available_modes"))
    )
    fielded = deployments.groupBy(F.col("product_id").alias("id")).agg(
        F.count(F.lit(1)).alias("deployment_count"), F.sum("contract_value").alias("contracted_value")
    )
    return (
        products.select("id", "slug", "name", F.col("commercial_status").alias("maturity"))
        .join(offers, "id", "left").join(fielded, "id", "left")
        .select(
            "id", "slug", "name", "maturity",
            F.col("available_modes").isNotNull().alias("is_obtainable"),
            F.coalesce("deployment_count", F.lit(0).cast("long")).alias("deployment_count"),
            "contracted_value",
            F.coalesce("available_modes", F.array().cast("array<string>")).alias("available_modes"),
        )
    )


def market_snapshot(products, availability, deployments, makers, evidence) -> DataFrame:
    """Eight figures of the whole market, in one row.

    Each source contributes one partial row; the rows are unioned and folded, so no pair of
    tables is ever crossed.
    """
    snap = commercial_snapshot(products, availability, deployments)
    state = snap.join(products.select("id", "is_published", "manufacturer_slug"), "id")
    live = F.col("is_published")
    renting = live & F.array_contains("available_modes", "RENTAL") | live & F.array_contains("available_modes", "SUBSCRIPTION")
    fielded = F.col("maturity").isin("PILOT", "RAAS_DEPLOYMENT") | (F.col("deployment_count") > 0)
    parts = [
        state.agg(
            F.count(F.lit(1)).alias("total_tracked"), F.count_if(live).alias("total_published"),
            F.count_if(live & F.col("is_obtainable")).alias("commercially_accessible"),
            F.count_if(live & fielded).alias("in_deployment_or_pilot"),
            F.count_distinct(F.when(live, F.col("manufacturer_slug"))).alias("manufacturers_published"),
            F.coalesce(F.bool_or(renting), F.lit(False)).alias("rental_offers_present"),
        ),
        makers.agg(F.count(F.lit(1)).alias("manufacturers_tracked")),
        evidence.agg(F.max("observed_at").alias("latest_observed_at")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def maker_coverage(makers: DataFrame, products: DataFrame) -> DataFrame:
    """Tracked and published product counts per maker; makers without products stay at zero."""
    counts = products.groupBy(F.col("manufacturer_slug").alias("slug")).agg(
        F.count(F.lit(1)).alias("tracked"), F.count_if("is_published").alias("published")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return makers.select("slug").join(counts, "slug", "left").select("slug", zero("tracked"), zero("published"))


def portfolio_status(makers: DataFrame, products: DataFrame) -> DataFrame:
    """Most mature active status among a maker's published products.

    DISCONTINUED only when all are; NULL when none is published; UNKNOWN ranks below the rest.
    """
    status = F.col("commercial_status")
    active = F.when(status != "DISCONTINUED", status)
    counts = products.filter("is_published").groupBy(F.col("manufacturer_slug").alias("slug")).agg(
        F.max_by(active, F.when(active.isNotNull(), vocab.ordinal(status, vocab.PORTFOLIO_STATUS))).alias("_best"),
        F.lit(True).alias("_any"),
    )
    return makers.select("slug").join(counts, "slug", "left").select(
        "slug",
        F.when(F.col("_any"), F.coalesce("_best", F.lit("DISCONTINUED"))).alias("portfolio_status"),
    )


def use_case_counts(use_cases: DataFrame, fits: DataFrame, products: DataFrame) -> DataFrame:
    """Published products per use case; use cases without any stay at zero."""
    live = products.filter("is_published").select(F.col("id").alias("product_id"))
    counts = fits.join(live, "product_id", "left_semi").groupBy(F.col("use_case").alias("slug")).agg(
        F.count_distinct("product_id").alias("product_count")
    )
    return use_cases.select("slug").join(counts, "slug", "left").select(
        "slug", F.coalesce("product_count", F.lit(0).cast("long")).alias("product_count")
    )


def catalogue_state(products, pricing, availability, deployments, evidence, images) -> DataFrame:
    """Stored against displayed row counts of every part of the catalogue."""
    from ..functions.rules import display_eligible

    def part(name, df, shown):
        return df.agg(F.count(F.lit(1)).alias("stored"), F.count_if(shown).alias("displayed")).select(
            F.lit(name).alias("part"), "stored", "displayed"
        )

    parts = [
        part("products", products, F.col("is_published")),
        part("pricing_offers", pricing, F.col("is_current")),
        part("availability_offers", availability, F.col("is_current")),
        part("deployments", deployments, F.lit(True)),
        part("evidence", evidence, F.col("confidence") == "VERIFIED"),
        part("images", images, F.coalesce(display_eligible(), F.lit(False))),
    ]
    return reduce(DataFrame.unionByName, parts)
