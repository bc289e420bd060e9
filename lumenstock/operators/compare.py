"""Side-by-side comparison of two to four products: facts, leaders and deltas, never a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.ranking import first_per_key

# Compared fields by group.
COMPARE_FIELDS = {
    "commercial": ["commercial_status"],
    "physical": ["height_cm", "weight_kg", "payload_kg", "walk_speed_ms", "runtime_minutes", "mobility"],
    "manipulation": ["hand_type", "hand_dof", "has_manipulation"],
    "intelligence": ["autonomy", "has_vision", "has_language_ui"],
    "developer": ["has_sdk", "ros_support", "developer_edition"],
}
# Fields where more is better, and numeric fields without a leader.
HIGHER_LEADS = ["payload_kg", "walk_speed_ms", "runtime_minutes", "degrees_of_freedom", "hand_dof"]
NUMERIC_ONLY = ["height_cm", "weight_kg"]
MIN_SET, MAX_SET = 2, 4


def valid_sets(sets: DataFrame) -> DataFrame:
    """Sets of two to four products; any other size is not compared."""
    sizes = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n").between(MIN_SET, MAX_SET))
    return sets.join(sizes.select("set_id"), "set_id", "left_semi")


def compare_cells(sets: DataFrame, products: DataFrame) -> DataFrame:
    """One row per set, field and product: text value, and number where the field is numeric."""
    numeric = set(HIGHER_LEADS + NUMERIC_ONLY)
    fields = [(g, f) for g, fs in COMPARE_FIELDS.items() for f in fs]
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(g).alias("field_group"), F.lit(f).alias("key"), F.col(f).cast("string").alias("value"),
            (F.col(f).cast("double") if f in numeric else F.lit(None).cast("double")).alias("number"),
        )
        for g, f in fields
    ])).alias("c")
    facts = products.select("slug", *[f for _, f in fields])
    return valid_sets(sets).join(facts, "slug").select("set_id", "slug", "position", cells).select("set_id", "slug", "position", "c.*")


def compare_matrix(sets: DataFrame, products: DataFrame) -> DataFrame:
    """(set, group, key, values): values as slug to text in requested order. At most four per row."""
    pairs = F.array_sort(F.collect_list(F.struct("position", "slug", "value")))
    return compare_cells(sets, products).groupBy("set_id", "field_group", "key").agg(pairs.alias("values"))


def best_in_row(cells: DataFrame) -> DataFrame:
    """Every product at the leading value of a leader-bearing field with two or more known values."""
    row = W.partitionBy("set_id", "key")
    led = cells.filter(F.col("key").isin(HIGHER_LEADS) & F.col("number").isNotNull())
    ranked = led.withColumn("_top", F.max("number").over(row)).withColumn("_known", F.count("number").over(row))
    return ranked.filter((F.col("_known") >= 2) & (F.col("number") == F.col("_top"))).select("set_id", "key", "slug")


def metric_delta(cells: DataFrame, reference_position: Column) -> DataFrame:
    """Signed difference to the reference product of the set, or why there is none."""
    reference = cells.filter(F.col("position") == reference_position).select(
        "set_id", "key", F.col("slug").alias("reference"), F.col("number").alias("_base")
    )
    numeric = F.col("key").isin(HIGHER_LEADS + NUMERIC_ONLY)
    kind = (
        F.when(F.col("slug") == F.col("reference"), "self").when(~numeric, "incomparable")
        .when(F.col("number").isNull() | F.col("_base").isNull(), "unknown").otherwise("numeric")
    )
    return cells.join(reference, ["set_id", "key"]).withColumn("kind", kind).withColumn(
        "delta", F.when(F.col("kind") == "numeric", (F.col("number") - F.col("_base")).cast("decimal(12,2)"))
    )


def _headlines(sets: DataFrame, pricing: DataFrame, products: DataFrame) -> DataFrame:
    """Set members with the offer they are compared by: purchase first, then type, then id."""
    kind = vocab.lookup(F.col("price_type"), {p: i for i, p in enumerate(vocab.PRICE_TYPE)}, 9)
    offer = first_per_key(
        pricing.filter("is_current"), ["product_id"],
        [F.when(F.col("transaction_type") == "PURCHASE", 0).otherwise(1), kind, F.col("id")],
        ["transaction_type", "price_type", "price", "currency", "billing_period"],
    )
    amount = F.when(F.col("price_type").isin(vocab.POINT_PRICE_TYPES), F.col("price"))
    ids = products.select("slug", F.col("id").alias("product_id"))
    return sets.join(ids, "slug").join(offer, "product_id", "left").withColumn("amount", amount)


def _terms() -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("|", blank("transaction_type"), blank("currency"), blank("billing_period"), blank("price_type"))


def price_leader(sets: DataFrame, pricing: DataFrame, products: DataFrame) -> DataFrame:
    """Lowest comparable price of each set, only where every offer is like for like; else the reason."""
    rows = _headlines(sets, pricing, products)
    per_set = rows.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("price_type").isNull()).alias("_unknown"),
        F.bool_or(F.col("amount").isNull()).alias("_open"), F.min(_terms()).alias("_t0"), F.max(_terms()).alias("_t1"),
        F.min("amount").alias("_low"),
        F.array_sort(F.collect_list(F.struct("amount", "slug"))).alias("_offers"),
    )
    reason = (
        F.when(F.col("_n") < MIN_SET, "NEED_AT_LEAST_TWO").when(F.col("_unknown"), "UNKNOWN_PRICE_PRESENT")
        .when(F.col("_open"), "NON_NUMERIC_OFFER_PRESENT").when(F.col("_t0") != F.col("_t1"), "MIXED_OFFER_SEMANTICS")
        .otherwise("LOWEST_COMPARABLE_PRICE")
    )
    winners = F.transform(F.filter("_offers", lambda o: o["amount"] == F.col("_low")), lambda o: o["slug"])
    none = F.array().cast("array<string>")
    return per_set.withColumn("reason", reason).select(
        "set_id", "reason", F.when(F.col("reason") == "LOWEST_COMPARABLE_PRICE", winners).otherwise(none).alias("winners")
    )


def price_delta(sets: DataFrame, pricing: DataFrame, products: DataFrame, reference_position: Column) -> DataFrame:
    """Signed price difference to the reference of the set where both offers are like for like."""
    rows = _headlines(sets, pricing, products).withColumn("_terms", F.when(F.col("amount").isNotNull(), _terms()))
    base = rows.filter(F.col("position") == reference_position).select(
        "set_id", F.col("slug").alias("reference"), F.col("amount").alias("_base"), F.col("_terms").alias("_base_terms")
    )
    kind = F.when(F.col("slug") == F.col("reference"), "self").when(F.col("_terms") == F.col("_base_terms"), "numeric").otherwise("incomparable")
    return rows.join(base, "set_id").withColumn("kind", kind).select(
        "set_id", "slug", "kind", F.when(F.col("kind") == "numeric", F.col("amount") - F.col("_base")).cast("decimal(14,2)").alias("delta")
    )


def deployment_leader(sets: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The one product of a set with strictly the most deployments; no row on a tie or when all are zero."""
    rows = sets.join(snapshot.select("slug", "deployment_count"), "slug")
    top = rows.groupBy("set_id").agg(F.max("deployment_count").alias("_top"))
    lead = rows.join(top, "set_id").filter((F.col("_top") > 0) & (F.col("deployment_count") == F.col("_top")))
    sole = lead.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n"), F.min("slug").alias("slug"), F.max("_top").alias("deployment_count"))
    return sole.filter("_n = 1").select("set_id", "slug", "deployment_count")
