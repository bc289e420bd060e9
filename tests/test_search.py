"""Filters never read unknown as no, and wrong inputs are refused."""

import pytest
from pyspark.sql import functions as F

from lumenstock.operators import search
from lumenstock.operators.search import Filters


def products(spark):
    rows = [(1, 10.0, True, None), (2, None, True, "ASSISTED"), (3, 5.0, True, None), (4, None, None, None), (5, None, False, None)]
    return spark.createDataFrame(rows, "id int, payload_kg double, has_sdk boolean, autonomy string").withColumn("is_published", F.lit(True))


def ids(df):
    return {r.id for r in df.collect()}


def test_null_satisfies_no_filter(spark):
    assert ids(search.by_facts(products(spark), Filters(payload_min=6, has_sdk=True))) == {1}
    assert ids(search.by_facts(products(spark), Filters(has_sdk=False))) == {5}


def test_unknown_notice_covers_only_undecided_products(spark):
    m = {"products": products(spark)}
    assert ids(search.unknown_excluded(m, Filters(payload_min=6, has_sdk=True))) == {2, 4}
    assert ids(search.unknown_excluded(m, Filters())) == set()


def test_stop_words_alone_match_nothing(spark):
    df = spark.createDataFrame([(1, "The red bolt", None)], "id int, name string, summary string")
    assert search.match_text(df, "the of").count() == 0
    assert search.match_text(df, "RED, bolt").count() == 1


@pytest.mark.parametrize("limit, offset", [(0, 0), (101, 0), (5, -1), (True, 0)])
def test_page_is_refused_not_clamped(spark, limit, offset):
    with pytest.raises(ValueError):
        search.page(products(spark), [F.col("id")], limit, offset)


@pytest.mark.parametrize("filters", [
    Filters(mobility="FLYING"), Filters(commercial_status=["PILOT", "SOLD"]), Filters(price_max=5), Filters(height_min=9, height_max=1),
])
def test_invalid_filters_are_refused(filters):
    with pytest.raises(ValueError):
        search.validate_filters(filters)


@pytest.mark.parametrize("key", ["", "-", "rating"])
def test_unknown_sort_key_is_refused(key):
    with pytest.raises(ValueError):
        search.order_by(key)


@pytest.mark.parametrize("key", ["name", "-name", "price", "-price", "payload", "-payload", "newest", "-newest"])
def test_every_sort_key_ranks(spark, key):
    rows = [("b", "s1", 1.0, 2.0, "2026-01-01"), ("a", "s2", None, 1.0, "2026-01-03"), ("b", "s0", 3.0, None, "2026-01-02")]
    df = spark.createDataFrame(rows, "name string, slug string, lowest_purchase_price double, payload_kg double, created_on string")
    df = df.withColumn("created_on", df.created_on.cast("date"))
    ranked = [r.slug for r in search.sort_catalogue(df, key).orderBy("rank").collect()]
    assert ranked == [r.slug for r in df.orderBy(*search.order_by(key)).collect()]


def test_empty_region_set_matches_nothing(spark):
    offers = spark.createDataFrame([(1, "PURCHASE", "AVAILABLE", None, True)], "product_id int, transaction_type string, availability_status string, region_id int, is_current boolean")
    nowhere = spark.createDataFrame([], "region_id int, applicable_id int")
    somewhere = spark.createDataFrame([(2, 2)], "region_id int, applicable_id int")
    assert ids(search.by_availability(products(spark), offers, regions=nowhere)) == set()
    assert ids(search.by_availability(products(spark), offers, regions=somewhere)) == {1}
    assert ids(search.by_availability(products(spark), offers)) == {1}
