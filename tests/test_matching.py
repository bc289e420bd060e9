"""Scoring rules one by one, list-length independence, and the empty outcomes."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumenstock.operators import matching as mt
from lumenstock.plans.matching import match_model
from lumenstock.sources.catalog import Catalog

PAIR = """requirement_id long, product_id long, slug string, class string, country_id int, country string, applicable_ids array<int>, use_case string,
payload_min_kg double, operating_hours_day double, manipulation_required boolean, autonomy_required string, required_level int, budget_currency string,
budget_min double, budget_max double, required_by date, commercial_status string, payload_kg double, has_manipulation boolean, autonomy string,
autonomy_level int, runtime_minutes int, fits map<string,double>, deployments long, open boolean, plain boolean, earliest date,
open_everywhere boolean, offered_everywhere boolean, open_regions array<int>, offered_regions array<int>,
prices array<struct<transaction_type:string,currency:string,region_id:int,billing_period:string,price_type:string,kind:string,low:double,top:double,floors:array<double>>>"""


def point(kind, low=None, top=None, floors=(), currency="USD", txn="PURCHASE", period="ONE_TIME", region=None):
    return (txn, currency, region, period, kind, kind, low, top, list(floors))


def pair(spark, **facts):
    schema = spark.createDataFrame([], PAIR).schema
    base = {"requirement_id": 1, "product_id": 1, "slug": "a", "class": "ANY", "commercial_status": "COMMERCIAL", "deployments": 0}
    return spark.createDataFrame([tuple({**base, **facts}.get(f.name) for f in schema)], schema)


def one(df, column):
    return df.collect()[0][column]


@pytest.mark.parametrize("facts, expected", [
    ({}, None),
    ({"payload_min_kg": 0.0}, 1.0),
    ({"payload_min_kg": 10.0}, 0.5),
    ({"payload_min_kg": 10.0, "payload_kg": 10.0}, 0.8),
    ({"payload_min_kg": 10.0, "payload_kg": 99.0}, 1.0),
    ({"required_level": 2, "autonomy_required": "SUPERVISED_AUTONOMY"}, 0.5),
    ({"required_level": 2, "autonomy_level": 3}, 1.0),
    ({"manipulation_required": True}, 0.5),
    ({"manipulation_required": False}, None),
    ({"operating_hours_day": 8.0, "runtime_minutes": 240}, 0.75),
    ({"operating_hours_day": 0.0, "runtime_minutes": 1}, 1.0),
    ({"payload_min_kg": 10.0, "manipulation_required": True, "has_manipulation": True}, 0.75),
])
def test_technical(spark, facts, expected):
    assert one(mt.score_technical(pair(spark, **facts)), mt.SUBS["technical_fit"]) == expected


@pytest.mark.parametrize("facts, expected", [
    ({}, 0.5),
    ({"open": False}, 0.0),
    ({"open": True}, 1.0),
    ({"open": True, "required_by": datetime.date(2026, 1, 1), "earliest": datetime.date(2026, 2, 1)}, 0.5),
    ({"open": True, "required_by": datetime.date(2026, 1, 1)}, 1.0),
])
def test_commercial(spark, facts, expected):
    assert one(mt.score_commercial(pair(spark, **facts)), mt.SUBS["commercial_availability"]) == expected


@pytest.mark.parametrize("facts, expected", [
    ({}, None),
    ({"country_id": 2, "applicable_ids": [0, 1, 2]}, 0.5),
    ({"country_id": 2, "applicable_ids": [0, 1, 2], "offered_regions": [1], "open_regions": []}, 0.0),
    ({"country_id": 2, "applicable_ids": [0, 1, 2], "offered_regions": [1], "open_regions": [1]}, 1.0),
    ({"country_id": 2, "applicable_ids": [0, 1, 2], "open_everywhere": True, "offered_everywhere": True}, 1.0),
    ({"country_id": 2, "applicable_ids": [0, 1, 2], "offered_regions": [9], "open_regions": [9]}, 0.5),
])
def test_geography(spark, facts, expected):
    assert one(mt.score_geography(pair(spark, **facts)), mt.SUBS["geographic_fit"]) == expected


BUDGET = {"budget_currency": "usd", "budget_max": 100.0}


@pytest.mark.parametrize("facts, sub, warnings", [
    ({}, None, None),
    ({"budget_min": 5.0}, 0.5, None),
    ({**BUDGET}, 0.5, None),
    ({**BUDGET, "prices": [point("PUBLIC", 100.0)]}, 1.0, []),
    ({**BUDGET, "prices": [point("PUBLIC", 105.0)]}, pytest.approx(0.5), [mt.W_OVER]),
    ({**BUDGET, "prices": [point("PUBLIC", 200.0)]}, 0.0, [mt.W_OVER]),
    ({**BUDGET, "prices": [point("PUBLIC", 50.0, currency="EUR")]}, 0.5, None),
    ({**BUDGET, "prices": [point("FROM", 50.0)]}, 0.75, [mt.W_START]),
    ({**BUDGET, "prices": [point("ESTIMATED", 50.0)]}, 1.0, [mt.W_ESTIMATE]),
    ({**BUDGET, "prices": [point("ESTIMATED", 50.0), point("PUBLIC", 60.0)]}, 1.0, []),
    ({**BUDGET, "prices": [point("QUOTE")]}, 0.5, [mt.W_QUOTE]),
    ({**BUDGET, "prices": [point("PERIOD", 5.0, period="MONTHLY")]}, 0.5, ["price is monthly — not comparable to a one-off budget"]),
    ({**BUDGET, "prices": [point("RANGE", top=90.0, floors=[10.0])]}, 1.0, []),
    ({**BUDGET, "prices": [point("RANGE", top=150.0, floors=[90.0])]}, 0.5, [mt.W_CROSS]),
    ({**BUDGET, "prices": [point("RANGE", top=150.0, floors=[102.0])]}, pytest.approx(0.8), [mt.W_ABOVE]),
    ({**BUDGET, "prices": [point("RANGE", top=150.0, floors=[90.0, 102.0])]}, pytest.approx(0.8), [mt.W_ABOVE]),
    ({**BUDGET, "class": "RENTAL", "prices": [point("PUBLIC", 50.0)]}, 0.5, None),
    ({**BUDGET, "country_id": 2, "applicable_ids": [2], "prices": [point("PUBLIC", 50.0, region=3)]}, 0.5, None),
    ({"budget_max": 100.0, "prices": [point("PUBLIC", 50.0)]}, 0.5, None),
])
def test_budget(spark, facts, sub, warnings):
    row = mt.score_budget(pair(spark, **facts)).collect()[0]
    assert row[mt.SUBS["budget_fit"]] == sub
    assert (row.best_price.warnings if row.best_price else None) == warnings


@pytest.mark.parametrize("facts, expected", [
    ({}, []),
    ({"payload_min_kg": 5.0, "payload_kg": 4.0}, ["payload"]),
    ({"payload_min_kg": 5.0}, []),
    ({"manipulation_required": True, "has_manipulation": False, "commercial_status": "DISCONTINUED"}, ["manipulation", "discontinued"]),
    ({"manipulation_required": True}, []),
    ({"autonomy_required": "TASK_AUTONOMOUS", "autonomy": "ASSISTED"}, ["autonomy"]),
    ({"autonomy_required": "TASK_AUTONOMOUS"}, []),
])
def test_exclusions_never_from_unknown(spark, facts, expected):
    raw = pair(spark, **facts).drop("autonomy_level", "required_level")
    assert one(mt.exclusions(raw), "exclusions") == expected


def test_weights_redistribute_and_round_half_even(spark):
    subs = {mt.SUBS[n]: F.lit(None).cast("double") for n in mt.CRITERIA}
    subs[mt.SUBS["commercial_availability"]] = F.lit(1.0)
    subs[mt.SUBS["deployment_readiness"]] = F.lit(0.5)
    row = mt.scored(spark.range(1).withColumns(subs)).collect()[0]
    assert row[mt.PARTS["commercial_availability"]] == 6667 and row[mt.PARTS["deployment_readiness"]] == 1667
    assert row[mt.PARTS["use_case_fit"]] == 0 and row.score == 83


@pytest.fixture(scope="module")
def small(spark):
    return match_model(Catalog(spark, "/root/testdata/sf0.001"))


def _rows(df):
    return sorted((r.requirement_id, r["rank"], r.slug, r.score) for r in df.collect())


def test_list_length_does_not_change_matches(spark, small):
    whole = _rows(mt.rank_matches(small, list_length=100_000))
    assert whole and _rows(mt.rank_matches(small, list_length=2)) == whole


def test_partitioning_does_not_change_matches(spark, small):
    shuffled = {**small, "products": small["products"].repartition(7), "pricing": small["pricing"].repartition(3, "currency")}
    assert _rows(mt.rank_matches(shuffled, 16)) == _rows(mt.rank_matches(small, 64))


def test_unreachable_amounts_settle_in_finer_lists(spark, small, monkeypatch):
    """Ten hours a day are beyond every product: the lists say so, and nobody reads the whole catalogue."""
    products = small["products"].withColumns({
        "runtime_minutes": F.lit(300), "payload_kg": F.lit(500).cast("decimal(6,1)"),
        "has_manipulation": F.lit(True), "autonomy": F.lit("HIGHLY_AUTONOMOUS"),
    })
    nothing = F.lit(None)
    needs = small["requirements"].filter("id % 10 = 0").withColumns({
        "operating_hours_day": F.lit(10), "budget_min": nothing.cast("double"), "budget_max": nothing.cast("double"), "required_by": nothing.cast("date"),
    })
    reads, survivors = [], mt._survivors
    monkeypatch.setattr(mt, "_survivors", lambda asked, entries, on: reads.append(on) or survivors(asked, entries, on))
    found = mt.rank_matches({**small, "products": products, "requirements": needs}, list_length=4)
    assert found.groupBy("requirement_id").count().filter("count = 4").count() == needs.count()
    assert reads and ["product_id", "class"] not in reads


def test_cells_do_not_grow_with_copies_and_lists_are_the_first(spark, small):
    """Bounds are scored once per cell and segment, so copies of products add entries and no scores."""
    run = mt.prepare(small)
    stock, segments = run["stock"], mt._segments(mt._finer(run["asked"], run["stock"], True))
    copies = stock.withColumns({"product_id": F.col("product_id") + 10**6, "slug": F.concat("slug", F.lit("-copy"))})
    both = stock.unionByName(copies)
    once = mt._levels(mt._cells(stock, segments), segments, None)
    assert mt._levels(mt._cells(both, segments), segments, None).count() == once.count() > 0
    cells = mt._cells(both, segments)
    first = mt.W.partitionBy("segment").orderBy("bound")
    whole = mt._bounds(cells, mt._levels(cells, segments, None)).withColumn("place", F.row_number().over(first)).filter("place <= 5")
    listed = lambda df: sorted((r.segment, r.place, r.product_id) for r in df.collect())
    assert listed(mt._lists(both, segments, 5)) == listed(whole)


def test_nothing_matches(spark, small):
    heavy = small["products"].withColumn("payload_kg", F.lit(1).cast("decimal(6,1)"))
    m = {**small, "products": heavy, "requirements": small["requirements"].withColumn("payload_min_kg", F.lit(50))}
    ranked = mt.rank_matches(m)
    assert ranked.count() == 0
    row = mt.no_match(m["requirements"], heavy, ranked).collect()[0]
    total = heavy.filter("is_published").count()
    assert row.explanation == (
        "No platform matched. The dominant eliminating constraint was payload: the stated minimum payload exceeded the known "
        f"capacity — {total} of {total} candidates."
    )
    empty = {**m, "products": heavy.filter("false")}
    row = mt.no_match(m["requirements"], empty["products"], ranked).collect()[0]
    assert row.explanation == "No published platforms are available to match yet." and row.excluded_count == 0
