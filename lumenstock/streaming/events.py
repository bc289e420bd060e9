"""Windowed counts over the event stream. The same functions run on batch and streaming input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed values: (window seconds, limit) per policy and tier.
POLICIES = {
    "buyer_requirements": {"burst": (60, 20), "sustained": (3600, 120)},
    "commercial_leads": {"burst": (60, 10), "sustained": (3600, 60)},
}


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    """Batch rows as they are; a stream gets its watermark, which needs an instant, not a local time."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def rate_tier(events: DataFrame, key: str, tier: str, seconds: int, limit: int, watermark: str = "1 hour") -> DataFrame:
    """Clients over the limit of one tier in an epoch-aligned window. Late rows past the watermark drop."""
    rows = _timed(events, watermark)
    counted = rows.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), F.col(key).alias("client")).agg(F.count(F.lit(1)).alias("hits"))
    return counted.filter(F.col("hits") > limit).select(F.lit(tier).alias("tier"), F.col("w.start").alias("window_start"), "client", "hits")


def rate_windows(events: DataFrame, key: str, tiers: dict[str, tuple[int, int]], watermark: str = "1 hour") -> DataFrame:
    """All tiers of a policy over a batch; a stream runs one `rate_tier` query per tier."""
    return reduce(DataFrame.unionByName, [rate_tier(events, key, name, *spec, watermark) for name, spec in tiers.items()])


def event_rollup(events: DataFrame, width: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Event counts by type per tumbling window."""
    rows = _timed(events, watermark)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), "event_type", "events"
    )


def late_rows(progress: list) -> int:
    """Rows a stream dropped because they came after the watermark, from the progress of its batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def append_rollup(events: DataFrame, store_path: str, checkpoint: str, width: str = "1 day", watermark: str = "1 hour") -> StreamingQuery:
    """Write every window once, when the watermark has passed its end. A window still open waits for later events.

    Rows that come too late for their window are not in the store; `late_rows` of the query's progress counts them.
    """
    return (event_rollup(events, width, watermark).writeStream.format("parquet").outputMode("append").option("path", store_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
