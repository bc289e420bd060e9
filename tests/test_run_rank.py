"""Positions of rows that move once: those of a window, with keys that fill several ranges or are unknown."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstock.functions import ranking


@pytest.mark.parametrize("hot", ["a", None])
def test_run_rank_is_row_number(spark, hot):
    key = F.when(F.col("id") % 10 < 8, F.lit(hot)).when(F.col("id") % 10 == 8, "b").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string")))
    df = spark.range(0, 20_000, 1, 5).select(key.alias("key"), (F.col("id") % 3).alias("part"), (F.col("id") * 7919 % 20_011).alias("value"))
    want = df.withColumn("at", F.row_number().over(W.partitionBy("key", "part").orderBy("value")))
    got = ranking.run_rank(df, [F.col("value")], ["key", "part"], "at", ["value"])
    assert got.columns == ["key", "part", "value", "at"]
    rows = lambda d: sorted((str(r.key), r.part, r.value, r["at"]) for r in d.collect())
    assert rows(got) == rows(want)


def test_run_rank_moves_rows_once(spark, monkeypatch):
    """Only what is asked for is stored, and no later step deals the rows out again."""
    stored, write = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, label, *codec: stored.append(df.columns) or write(df, label, *codec))
    df = spark.range(1000).select((F.col("id") % 7).alias("key"), F.col("id").alias("value"), F.col("id").cast("string").alias("text"))
    got = ranking.run_rank(df, [F.col("value")], ["key"], "at", ["text"])
    assert stored[0] == ["key", "text", "_range", "at", "_head"]
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    df = spark.range(0).select("id", F.lit(1).alias("value"))
    assert ranking.run_rank(df, [F.col("value")], ["id"], "at", ["value"]).count() == 0
