"""Rate limits on a stream of requests, two tiers per policy, with windows that start at a client's first request."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import POLICIES

# What becomes of a request. A refusal names the tier that refused.
OUTCOMES = ["accepted", "burst", "sustained", "late"]
DECISION = "policy string, client string, id long, ts timestamp, outcome string, hits long, retry_after long"
# Per tier: start of its window in microseconds and requests counted in it; and the latest request decided.
STATE = "burst_start long, burst_hits long, sustained_start long, sustained_hits long, last long"


def hit(now: int, start: int | None, hits: int, seconds: int) -> tuple[int, int]:
    """A window after one more request: a window that is over starts anew at the request."""
    if start is None or now - start >= seconds * 1_000_000:
        start, hits = now, 0
    return start, hits + 1


def decide(now: int, state: tuple, tiers: dict[str, tuple[int, int]]) -> tuple[tuple, str, int, int]:
    """(state, outcome, hits, seconds to wait) of a request. Burst goes first, and what it refuses does not count for sustained."""
    burst, burst_hits, sustained, sustained_hits, last = state
    if last is not None and now < last:
        return state, "late", 0, 0
    wait = lambda start, seconds: min(max(1, math.ceil((seconds * 1_000_000 - (now - start)) / 1_000_000)), seconds)
    seconds, limit = tiers["burst"]
    burst, burst_hits = hit(now, burst, burst_hits, seconds)
    if burst_hits > limit:
        return (burst, burst_hits, sustained, sustained_hits, now), "burst", burst_hits, wait(burst, seconds)
    seconds, limit = tiers["sustained"]
    sustained, sustained_hits = hit(now, sustained, sustained_hits, seconds)
    state = (burst, burst_hits, sustained, sustained_hits, now)
    if sustained_hits > limit:
        return state, "sustained", sustained_hits, wait(sustained, seconds)
    return state, "accepted", sustained_hits, 0


def _decisions(policies: dict[str, dict[str, tuple[int, int]]]):
    def run(key, parts: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:  # both windows are over: a fresh client
            state.remove()
            return
        rows = pd.concat(parts).sort_values(["ts", "id"])
        tiers = policies[key[0]]
        held = state.get if state.exists else (None, 0, None, 0, None)
        out = []
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        for now in micros.tolist():
            held, *decision = decide(now, held, tiers)
            out.append(decision)
        state.update(held)
        # The later end of both windows; a watermark past it lets the state go.
        ends = [start + tiers[name][0] * 1_000_000 for name, start in (("burst", held[0]), ("sustained", held[2])) if start is not None]
        state.setTimeoutTimestamp(max(max(ends) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        decided = pd.DataFrame(out, columns=["outcome", "hits", "retry_after"], index=rows.index)
        yield pd.concat([rows[["policy", "client", "id", "ts"]], decided], axis=1)

    return run


def rate_decisions(requests: DataFrame, policies: dict | None = None, watermark: str = "10 minutes") -> DataFrame:
    """What becomes of every request of a stream (policy, client, id, ts): accepted, refused by a tier, or late.

    Requests of a client in one micro-batch are decided in order of time. One that is older than a request of its client
    decided before is `late` and counts for nothing; one older than the watermark is dropped by Spark and counted in the
    query's progress. A policy that is not registered fails the query is built.
    """
    policies = POLICIES if policies is None else policies
    known = requests.withColumn("policy", F.when(F.col("policy").isin(list(policies)), F.col("policy")).otherwise(F.raise_error("unknown rate-limit policy")))
    timed = known.select("policy", F.col("client").cast("string").alias("client"), "id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return timed.groupBy("policy", "client").applyInPandasWithState(_decisions(policies), DECISION, STATE, "append", "EventTimeTimeout")
