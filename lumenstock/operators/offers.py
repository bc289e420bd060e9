"""Offers and prices: best-price attachment, ceilings, headline and lowest prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.ranking import first_per_key
from ..functions.rules import accessible, comparable_amount
from .regions import global_id

VERTICALS = {
    "rental": ["RENTAL", "SUBSCRIPTION"],
    "purchase": ["PURCHASE", "DEVELOPER"],
    "lease": ["LEASE", "RAAS"],
}
PRICE_COLUMNS = ["price", "price_min", "price_max", "currency", "billing_period", "price_type"]


def newest(name: str) -> Column:
    """Ascending-sort stand-in for a date or a timestamp in descending order, to the microsecond."""
    return -F.unix_micros(F.col(name).cast("timestamp"))


def _scope(provider: Column, region: Column, variant: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit("*"))
    return F.concat_ws("|", part(provider), part(region), part(variant))


def _bit(scope: Column) -> Column:
    """One of the 64 bits of a mask of scopes."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(scope), F.lit(64)).cast("int"))


def commercial_offer(availability: DataFrame, pricing: DataFrame, region: DataFrame) -> DataFrame:
    """Each availability row with its single most specific current price, or none.

    A price fits when product and transaction agree and its provider, region and variant are
    equal to the offer's or unstated; a parent or global region also fits. Preference: provider,
    then region (exact, parent, global, none), then variant, then newest, then id.

    Prices are first reduced to one per exact scope. An offer then looks up its few possible
    scopes by equality, so a product with many offers and many prices never multiplies them.
    Most of those scopes hold no price: prices leave one bit each in a mask of their product and
    transaction, and only scopes whose bit is set are looked up.
    """
    scoped = pricing.filter("is_current").withColumn("_scope", _scope(F.col("provider_id"), F.col("region_id"), F.col("variant_id")))
    order = [newest("updated_at"), F.col("id")]
    best = first_per_key(
        scoped.select("*", F.col("provider_id").alias("price_provider_id"), F.col("region_id").alias("price_region_id")),
        ["product_id", "transaction_type", "_scope"], order, [*PRICE_COLUMNS, "price_provider_id", "price_region_id"], ["_newest", "pricing_offer_id"],
    )
    held = scoped.groupBy("product_id", "transaction_type").agg(F.bit_or(_bit(F.col("_scope"))).alias("_held"))

    parents = region.select(F.col("id").alias("region_id"), F.col("parent_id").alias("_parent"))
    placed = availability.join(parents, "region_id", "left").withColumn("_global", global_id(region))
    regions = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("region_id").alias("id")),
        F.struct(F.lit(1).alias("rank"), F.col("_parent").alias("id")),
        F.struct(F.lit(2).alias("rank"), F.col("_global").alias("id")),
        F.struct(F.lit(3).alias("rank"), F.lit(None).cast("int").alias("id")),
    )
    # The least rank wins where two levels name the same region; unknown levels drop out.
    regions = F.filter(
        regions,
        lambda r: ((r["rank"] == 3) | r["id"].isNotNull())
        & ~((r["rank"] == 1) & F.coalesce(r["id"] == F.col("region_id"), F.lit(False)))
        & ~((r["rank"] == 2) & F.coalesce((r["id"] == F.col("region_id")) | (r["id"] == F.col("_parent")), r["id"].eqNullSafe(F.col("region_id")))),
    )

    def either(name: str) -> Column:
        stated = F.struct(F.lit(0).alias("rank"), F.col(name).cast("string").alias("id"))
        unstated = F.struct(F.lit(1).alias("rank"), F.lit(None).cast("string").alias("id"))
        return F.explode(F.filter(F.array(stated, unstated), lambda s: (s["rank"] == 1) | s["id"].isNotNull()))

    keys = (
        placed.select("id", "product_id", "transaction_type", "provider_id", "variant_id", "region_id", "_parent", "_global")
        .join(held, ["product_id", "transaction_type"])
        .select("id", "product_id", "transaction_type", "provider_id", "variant_id", "_held", F.explode(regions).alias("r"))
        .select("*", either("provider_id").alias("p"))
        .select("*", either("variant_id").alias("v"))
        .select(
            F.col("id").alias("_offer"), "product_id", "transaction_type",
            _scope(F.col("p.id"), F.col("r.id"), F.col("v.id")).alias("_scope"),
            F.col("p.rank").alias("_p"), F.col("r.rank").alias("_r"), F.col("v.rank").alias("_v"), "_held",
        )
        .filter(F.col("_held").bitwiseAND(_bit(F.col("_scope"))) != 0).drop("_held")
    )
    carried = ["pricing_offer_id", *PRICE_COLUMNS, "price_provider_id", "price_region_id"]
    chosen = first_per_key(
        keys.join(best, ["product_id", "transaction_type", "_scope"]),
        ["_offer"],
        [F.col("_p"), F.col("_r"), F.col("_v"), F.col("_newest"), F.col("pricing_offer_id")],
        carried,
    )
    return availability.join(chosen, F.col("id") == F.col("_offer"), "left").drop("_offer")


def vertical_offers(offers: DataFrame, kind: str) -> DataFrame:
    return offers.filter(F.col("transaction_type").isin(VERTICALS[kind]))


def _purchases(pricing: DataFrame, currency: str) -> DataFrame:
    return pricing.filter(
        F.col("is_current") & (F.col("transaction_type") == "PURCHASE") & (F.col("currency") == currency.upper())
    ).withColumn("amount", comparable_amount())


def lowest_comparable(pricing: DataFrame, currency: str) -> DataFrame:
    """(product_id, amount): the lowest comparable purchase price in one currency."""
    return _purchases(pricing, currency).filter("amount IS NOT NULL").groupBy("product_id").agg(F.min("amount").alias("amount"))


def under_ceiling(products: DataFrame, pricing: DataFrame, price_max, currency: str) -> DataFrame:
    """Products with some comparable purchase price in exactly this currency within the ceiling."""
    fits = _purchases(pricing, currency).filter(F.col("amount") <= F.lit(price_max).cast("decimal(14,2)"))
    return products.join(fits.select(F.col("product_id").alias("id")), "id", "left_semi")


def price_comparability(products: DataFrame, pricing: DataFrame, price_max, currency: str) -> DataFrame:
    """Per product: qualifies, above the limit, or unprovable (nothing comparable to compare)."""
    lowest = lowest_comparable(pricing, currency).withColumnRenamed("product_id", "id")
    verdict = (
        F.when(F.col("amount").isNull(), "unprovable")
        .when(F.col("amount") <= F.lit(price_max).cast("decimal(14,2)"), "qualifies")
        .otherwise("above_limit")
    )
    return products.join(lowest, "id", "left").withColumn("comparability", verdict)


def ceiling_flags(products: DataFrame, pricing: DataFrame, price_max, currency: str) -> DataFrame:
    """Whether any product of the whole query is absent for price; false over no products."""
    rows = price_comparability(products, pricing, price_max, currency)
    some = lambda v: F.coalesce(F.bool_or(F.col("comparability") == v), F.lit(False))
    return rows.agg(some("above_limit").alias("above_limit"), some("unprovable").alias("unprovable"))


def lowest_price(pricing: DataFrame) -> DataFrame:
    """Cheapest current public or from purchase price, whatever its currency (sorting only)."""
    rows = pricing.filter(
        F.col("is_current") & (F.col("transaction_type") == "PURCHASE") & F.col("price_type").isin("PUBLIC", "FROM")
        & F.col("price").isNotNull()
    )
    best = first_per_key(rows, ["product_id"], [F.col("price"), F.col("currency")], ["price", "currency"])
    return best.select("product_id", F.col("price").alias("lowest_purchase_price"), F.col("currency").alias("lowest_price_currency"))


def headline_price(pricing: DataFrame) -> DataFrame:
    """The price a product is shown with: purchase first, then the most concrete type, then newest."""
    mode = F.when(F.col("transaction_type") == "PURCHASE", 0).when(F.col("transaction_type") == "DEVELOPER", 1).otherwise(9)
    kind = vocab.lookup(F.col("price_type"), {p: i for i, p in enumerate(vocab.PRICE_TYPE)}, 9)
    return first_per_key(
        pricing.filter("is_current").withColumn("pricing_id", F.col("id")), ["product_id"],
        [mode, kind, newest("updated_at"), F.col("id")],
        ["pricing_id", "transaction_type", *PRICE_COLUMNS],
    )


def representative_availability(availability: DataFrame, by_mode: bool = False) -> DataFrame:
    """One status per product (and mode): an accessible offer's if any, else any offer's.

    Among equals the lower status ordinal, then the lower id is taken.
    """
    keys = ["product_id", "transaction_type"] if by_mode else ["product_id"]
    return first_per_key(
        availability.filter("is_current"), keys,
        [F.when(accessible(F.col("availability_status")), 0).otherwise(1),
         vocab.ordinal(F.col("availability_status"), vocab.AVAILABILITY_STATUS), F.col("id")],
        ["availability_status"],
    )
