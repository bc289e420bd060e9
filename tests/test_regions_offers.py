"""Region closure with cycles, and each level of price specificity."""

from pyspark.sql import functions as F

from lumenstock.operators import offers, regions

REGIONS = [(0, None, "GLOBAL", "GLOBAL"), (1, None, "ECONOMIC_ZONE", "EU"), (2, 1, "COUNTRY", "DE"), (3, 1, "COUNTRY", "FR")]
PRICE = "id string, product_id long, variant_id string, provider_id long, region_id int, transaction_type string, price_type string, currency string, price double, price_min double, price_max double, billing_period string, is_current boolean, updated_at date"
OFFER = "id string, product_id long, variant_id string, provider_id long, region_id int, transaction_type string, availability_status string, is_current boolean"


def region(spark):
    return spark.createDataFrame(REGIONS, "id int, parent_id int, type string, code string")


def price(pid, variant=None, provider=None, region_id=None, day="2026-01-01", current=True, txn="PURCHASE"):
    import datetime

    return (pid, 1, variant, provider, region_id, txn, "PUBLIC", "USD", 1.0, None, None, "ONE_TIME", current, datetime.date.fromisoformat(day))


def attached(spark, prices, region_id=2, variant=None, provider=7):
    offer = spark.createDataFrame([("a", 1, variant, provider, region_id, "PURCHASE", "AVAILABLE", True)], OFFER)
    rows = offers.commercial_offer(offer, spark.createDataFrame(prices, PRICE), region(spark)).collect()
    assert len(rows) == 1
    return rows[0].pricing_offer_id


def test_cycle_ends(spark):
    loop = spark.createDataFrame([(1, 2, "COUNTRY", "A"), (2, 1, "COUNTRY", "B")], "id int, parent_id int, type string, code string")
    rows = {(r.region_id, r.ancestor_id) for r in regions.region_closure(loop).collect()}
    assert rows == {(1, 1), (1, 2), (2, 2), (2, 1)}


def test_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, "R", str(i)) for i in range(23)] + [(50, 99, "R", "x"), (60, 61, "R", "y"), (61, 62, "R", "z"), (62, 61, "R", "w")],
                                  "id int, parent_id int, type string, code string")
    rows = {}
    for r in regions.region_closure(chain).collect():
        rows.setdefault(r.region_id, {})[r.ancestor_id] = r.depth
    assert all(rows[i] == {i - d: d for d in range(i + 1)} for i in range(23))
    assert rows[50] == {50: 0, 99: 1} and rows[60] == {60: 0, 61: 1, 62: 2} and rows[62] == {62: 0, 61: 1}


def test_newest_by_time_of_day(spark):
    import datetime

    at = lambda h: datetime.datetime(2026, 1, 1, h)
    prices = spark.createDataFrame([price("b")[:-1] + (at(9),), price("a")[:-1] + (at(8),)], PRICE.replace("updated_at date", "updated_at timestamp"))
    offer = spark.createDataFrame([("a", 1, None, 7, 2, "PURCHASE", "AVAILABLE", True)], OFFER)
    assert offers.commercial_offer(offer, prices, region(spark)).first().pricing_offer_id == "b"
    assert offers.headline_price(prices).first().pricing_id == "b"


def test_unknown_code_applies_nowhere(spark):
    reg = region(spark)
    rows = regions.applicable_regions(regions.region_closure(reg), reg)
    assert rows.filter(F.col("code") == "XX").count() == 0
    assert {r.applicable_id for r in rows.filter("code = 'DE'").collect()} == {0, 1, 2}


def test_region_specificity(spark):
    exact, parent, top, none = (price(n, region_id=r) for n, r in [("e", 2), ("p", 1), ("g", 0), ("n", None)])
    assert attached(spark, [none, top, parent, exact]) == "e"
    assert attached(spark, [none, top, parent]) == "p"
    assert attached(spark, [none, top]) == "g"
    assert attached(spark, [none]) == "n"
    assert attached(spark, [price("x", region_id=3)]) is None


def test_provider_beats_region_and_never_leaks(spark):
    assert attached(spark, [price("e", region_id=2), price("q", provider=7)]) == "q"
    assert attached(spark, [price("other", provider=8, region_id=2)]) is None


def test_variant_then_newest_then_id(spark):
    assert attached(spark, [price("a"), price("v", variant="V")], variant="V") == "v"
    assert attached(spark, [price("v", variant="V")]) is None
    assert attached(spark, [price("old"), price("new", day="2026-02-01")]) == "new"
    assert attached(spark, [price("b"), price("a")]) == "a"
    assert attached(spark, [price("gone", current=False), price("rent", txn="RENTAL")]) is None


def test_hot_product_keeps_one_row_per_offer(spark):
    many = spark.range(2000).select(
        F.concat(F.lit("o"), "id").alias("id"), F.lit(1).cast("long").alias("product_id"), F.lit(None).cast("string").alias("variant_id"),
        (F.col("id") % 500).alias("provider_id"), F.lit(2).alias("region_id"), F.lit("PURCHASE").alias("transaction_type"),
        F.lit("AVAILABLE").alias("availability_status"), F.lit(True).alias("is_current"))
    prices = spark.createDataFrame([price("n")], PRICE)
    assert offers.commercial_offer(many, prices, region(spark)).filter("pricing_offer_id = 'n'").count() == 2000


def test_only_scopes_that_may_hold_a_price_are_looked_up(spark):
    """Against all pairs, with few prices to a product, and with more than a mask tells apart."""
    import random

    rng = random.Random(3)
    parents = {r[0]: r[1] for r in REGIONS}
    some = lambda *values: rng.choice([None, *values])
    prices = [(f"p{i}", *price(None, some("v1", "v2"), rng.choice([None, *range(60)]), some(0, 1, 2, 3), f"2026-01-{1 + i % 9:02}", i % 8 > 0)[1:]) for i in range(900)]
    prices = [(p[0], 1 if i % 3 else 2 + i % 40, *p[2:]) for i, p in enumerate(prices)]
    given = [(f"a{i}", rng.choice([1, 1, *range(2, 44)]), some("v1", "v2"), some(*range(60)), some(0, 1, 2, 3), "PURCHASE", "AVAILABLE", True) for i in range(400)]

    def best(o):
        levels = [r for r in dict.fromkeys([o[4], parents.get(o[4]), 0]) if r is not None] + [None]
        fits = [p for p in prices if p[1] == o[1] and p[12] and p[2] in (None, o[2]) and p[3] in (None, o[3]) and p[4] in levels]
        level = lambda p: 3 if p[4] is None else 0 if p[4] == o[4] else 1 if p[4] == parents.get(o[4]) else 2
        return min(fits, key=lambda p: (p[3] is None, level(p), p[2] is None, -p[13].toordinal(), p[0]))[0] if fits else None

    found = offers.commercial_offer(spark.createDataFrame(given, OFFER), spark.createDataFrame(prices, PRICE), region(spark))
    assert {r.id: r.pricing_offer_id for r in found.collect()} == {o[0]: best(o) for o in given}
    assert "bit_or" in found._jdf.queryExecution().optimizedPlan().toString()
