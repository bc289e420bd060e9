"""Matches read block by block: those of scoring every pair, whatever the blocks, also where rows repeat."""

import pytest
from pyspark.sql import functions as F

from lumenstock.operators import match_blocks
from lumenstock.operators import matching as mt
from lumenstock.plans.matching import match_model
from lumenstock.sources.catalog import Catalog


@pytest.fixture(scope="module")
def small(spark):
    m = match_model(Catalog(spark, "/root/testdata/sf0.001"))
    # One in thirteen products and one in seven buyers come twice; some facts and demands are unknown.
    products = m["products"].unionByName(m["products"].filter("id % 13 = 1")).withColumn("payload_kg", F.expr("if(id % 5 = 0, null, payload_kg)"))
    buyers = m["requirements"].unionByName(m["requirements"].filter("id % 7 = 3")).withColumn("budget_max", F.expr("if(id % 31 = 0, 0.0, budget_max)"))
    return {**m, "products": products, "requirements": buyers}


def _rows(df):
    return sorted((r.requirement_id, r["rank"], r.slug, r.score, *[r[c] for c in (*mt.SUBS.values(), *mt.PARTS.values())]) for r in df.collect())


def _every_pair(run):
    stock = mt._by_class(run["products"]).filter("commercial_status <> 'DISCONTINUED'")
    pairs = run["buyers"].join(stock, "class")
    for rule in mt._violations().values():
        pairs = pairs.filter(~rule)
    return mt._best(mt.score_pairs(pairs))


def test_blocks_give_the_matches_of_every_pair(spark, small, monkeypatch):
    run = mt.prepare(small)
    want = _rows(_every_pair(run))
    assert want and _rows(mt.rank_prepared(run)) == want
    for name, value in {"BLOCK": 40, "SAMPLE": 30, "READERS": 25, "CROWD": 60}.items():
        monkeypatch.setattr(mt, name, value)
    assert _rows(mt.rank_prepared(run)) == want


def test_a_known_fourth_match_leaves_most_unscored(spark, small, monkeypatch):
    """The second round knows a fourth match from the first: here that of all products, so only ties of it are scored again."""
    seen, read = [], mt._read_blocks
    monkeypatch.setattr(mt, "_read_blocks", lambda products, demands, *rest: seen.append((products, demands, read(products, demands, *rest))) or seen[-1][2])
    mt.rank_prepared(mt.prepare(small))
    products, demands, found = seen[0]
    fourth = [c for c in demands.columns if c.startswith("f_")]
    dealt, parts = mt._parted(demands, 10**6)
    block, scored, pairs = mt._shipped(products, parts).filter("class = 'ANY'").toArrow(), [], match_blocks._pairs
    monkeypatch.setattr(match_blocks, "_pairs", lambda d, p, b, *rest: scored.append(len(b)) or pairs(d, p, b, *rest))
    asked = dealt.filter("class = 'ANY'").join(found.groupBy("demand").count().filter("count = 4"), "demand", "left_semi")
    match_blocks.best_in_block(block, asked.toArrow())
    first = sum(scored)
    scored.clear()
    match_blocks.best_in_block(block, asked.drop(*fourth).join(mt._fourth(found), "demand").toArrow())
    assert 0 < 4 * sum(scored) < first < len(block) * asked.count()


def test_nothing_to_read(spark, small):
    for empty in ("products", "requirements"):
        assert mt.rank_matches({**small, empty: small[empty].filter("false")}).count() == 0
