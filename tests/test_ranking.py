"""Spread ranking equals row_number, also when one key holds most rows, on any partitioning."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstock.functions.ranking import first_per_key, spread_rank


@pytest.mark.parametrize("parts", [1, 5])
def test_spread_rank_equals_row_number(spark, parts):
    df = spark.range(4000, numPartitions=parts).select(
        "id", F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id") % 50).alias("k"), (F.xxhash64("id") % 7).alias("v")
    )
    got = {(r.id, r["rank"]) for r in spread_rank(df, [F.col("v"), F.col("id")], ["k"]).collect()}
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy("v", "id")))
    assert got == {(r.id, r["rank"]) for r in want.collect()}


def test_spread_rank_over_whole_table(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("v"))
    ranks = spread_rank(df, [F.col("v"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 3001))
    assert [r.v for r in ranks] == sorted(r.v for r in ranks)


def test_first_per_key_breaks_ties_by_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, 9, "q")], "k int, o int, v string")
    got = {(r.k, r.v) for r in first_per_key(df, ["k"], [F.col("o"), F.col("v")], ["v"]).collect()}
    assert got == {(1, "a"), (2, "q")}


def test_descending_text(spark):
    df = spark.createDataFrame([("a", 1), ("c", 2), ("b", 3), ("c", 0)], "v string, id int")
    got = spread_rank(df, [(F.col("v"), True), F.col("id")]).orderBy("rank").collect()
    assert [(r.v, r.id) for r in got] == [("c", 0), ("c", 2), ("b", 3), ("a", 1)]
