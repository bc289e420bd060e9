"""Streams: results that do not depend on the batches, late rows, limits against a plain replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenstock.plans.ingest import ingested
from lumenstock.sources.catalog import Catalog
from lumenstock.streaming import candidates, events, limits
from lumenstock.streaming.replay import replay

START = dt.datetime(2026, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_intake_does_not_depend_on_batches(spark, sf_dir, slices):
    c = Catalog(spark, sf_dir)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    if not hasattr(test_intake_does_not_depend_on_batches, "want"):
        test_intake_does_not_depend_on_batches.want = rows(ingested(c, 2))
    got = rows(ingested(c, slices))
    assert got == test_intake_does_not_depend_on_batches.want and len(got) > 20


def test_the_earliest_sighting_is_kept_though_it_comes_last(spark, tmp_path):
    sources = spark.createDataFrame([("s", True, "ALLOWED", "ALLOWED", dt.date(2026, 1, 1), "R")], "key string, is_enabled boolean, tos_status string, robots_status string, reviewed_at date, reviewed_by string")
    schema = "candidate_id long, source string, external_ref string, name string, seen_at timestamp"
    folder, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    for part in ([(5, "s", "r", "second", at(50)), (5, "s", "r", "second", at(50)), (9, "x", "r", "refused", at(1))], [(7, "s", "r", "third", at(90)), (3, "s", "r", "first", at(10)), (5, "s", "r", "second", at(50))]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        candidates.stream_ingest(spark.readStream.schema(schema).parquet(folder), store, sources, mark).awaitTermination()
    assert [tuple(r) for r in candidates.current_candidates(spark, store).collect()] == [("s", "r", 3, "first", at(10), at(90), 3)]


# ---- limits ------------------------------------------------------------------------------------

POLICIES = {"p": {"burst": (10, 3), "sustained": (60, 7)}, "q": {"burst": (5, 1), "sustained": (20, 2)}}


def plain(requests):
    """Windows by their first request, tier by tier, one request after the other."""
    windows, out = {}, {}

    def hit(key, now, seconds):
        start, n = windows.get(key, (now, 0))
        if (now - start).total_seconds() >= seconds:
            start, n = now, 0
        windows[key] = (start, n + 1)
        return n + 1

    for policy, client, i, ts in sorted(requests, key=lambda r: (r[3], r[2])):
        out[i] = "accepted"
        for tier in ("burst", "sustained"):
            seconds, limit = POLICIES[policy][tier]
            if hit((policy, tier, client), ts, seconds) > limit:
                out[i] = tier
                break
    return out


def decisions(spark, tmp_path, requests, slices):
    folder, store, mark = (str(tmp_path / f"{n}{slices}") for n in ("in", "out", "mark"))
    rows = spark.createDataFrame(requests, "policy string, client string, id long, ts timestamp").repartition(3)

    def start(feed):
        return (limits.rate_decisions(feed, POLICIES).writeStream.format("parquet").option("path", store).option("checkpointLocation", mark)
                .outputMode("append").trigger(availableNow=True).start())

    replay(rows, "ts", slices, folder, start)
    return {r.id: r for r in spark.read.parquet(store).collect()}


@pytest.mark.parametrize("slices", [1, 4])
def test_limits_are_a_plain_replay(spark, tmp_path, slices):
    rng = random.Random(2)
    requests = [(rng.choice("pq"), rng.choice("abc"), i, at(rng.choice([rng.randrange(90), rng.randrange(2000)]) + rng.random())) for i in range(300)]
    requests += [("p", "hot", 1000 + i, at(i / 2)) for i in range(200)] + [("p", "same", 2000 + i, at(7)) for i in range(6)]
    got = decisions(spark, tmp_path, requests, slices)
    want = plain(requests)
    assert {i: r.outcome for i, r in got.items()} == want
    assert {"accepted", "burst", "sustained"} <= set(want.values())
    assert all((r.retry_after >= 1) == (r.outcome != "accepted") for r in got.values())
    assert all(r.retry_after <= POLICIES[r.policy][r.outcome][0] for r in got.values() if r.outcome != "accepted")


def test_a_request_behind_its_client_is_late_and_counts_for_nothing(spark, tmp_path):
    folder, store, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "policy string, client string, id long, ts timestamp"
    for part in ([("q", "a", 1, at(100)), ("q", "b", 2, at(100))], [("q", "a", 3, at(90)), ("q", "a", 4, at(106)), ("q", "b", 5, at(101))]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        (limits.rate_decisions(spark.readStream.schema(schema).parquet(folder), POLICIES).writeStream.format("parquet").option("path", store)
         .option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination())
    got = {r.id: r.outcome for r in spark.read.parquet(store).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "late", 4: "accepted", 5: "burst"}


def test_an_unknown_policy_fails(spark, tmp_path):
    spark.createDataFrame([("nope", "a", 1, at(0))], "policy string, client string, id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("policy string, client string, id long, ts timestamp").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="unknown rate-limit policy"):
        limits.rate_decisions(feed, POLICIES).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()


# ---- rollup ------------------------------------------------------------------------------------


def test_append_windows_close_once_and_late_rows_are_counted(spark, tmp_path):
    folder, store, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema, hour = "id long, event_type string, ts timestamp", 3600
    progress = []
    for part in ([(1, "a", at(0)), (2, "a", at(10)), (3, "b", at(30 * hour))], [(4, "a", at(20)), (5, "b", at(31 * hour))], [(6, "c", at(80 * hour))]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        query = events.append_rollup(spark.readStream.schema(schema).parquet(folder), store, mark)
        query.awaitTermination()
        progress += query.recentProgress
    got = {(r.event_type, r.window_start, r.events) for r in spark.read.parquet(store).collect()}
    assert got == {("a", at(0), 2), ("b", at(24 * hour), 2)}
    assert events.late_rows(progress) == 1
