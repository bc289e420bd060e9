"""Candidate intake from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import radar_eligible

KEY = ["source", "external_ref"]
DELIVERY = [*KEY, "candidate_id", "seen_at"]


def once_delivered(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """A stream without repeated deliveries: the same candidate of the same sighting, if it comes again within the watermark."""
    timed = stream.withColumn("_seen", F.col("seen_at").cast("timestamp")).withWatermark("_seen", within)
    return timed.dropDuplicatesWithinWatermark(DELIVERY).drop("_seen")


def fold_batch(batch: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per key of a micro-batch: its earliest record, when it was last seen, and how often."""
    allowed = sources.filter(radar_eligible()).select(F.col("key").alias("source"))
    return batch.join(allowed, "source", "left_semi").groupBy(*KEY).agg(
        F.min(F.struct("seen_at", "candidate_id", "name")).alias("first"), F.max("seen_at").alias("last_seen_at"), F.count(F.lit(1)).alias("sightings")
    )


def stream_ingest(stream: DataFrame, store_path: str, sources: DataFrame, checkpoint: str, within: str = "30 days") -> StreamingQuery:
    """Append each micro-batch, without repeated deliveries and folded by key, to the store.

    A batch always writes its own directory, so a replay after a failure replaces what the first
    attempt left. The store is never rewritten; `current_candidates` folds the batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fold_batch(batch, sources).write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    return (
        once_delivered(stream, within).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_candidates(spark: SparkSession, store_path: str) -> DataFrame:
    """The store by key: the record seen first (equal times: the least id), the latest sighting, and the number of sightings.

    Least, greatest and sum do not depend on how the stream was cut into batches.
    """
    rows = spark.read.parquet(store_path)
    folded = rows.groupBy(*KEY).agg(F.min("first").alias("first"), F.max("last_seen_at").alias("last_seen_at"), F.sum("sightings").alias("sightings"))
    return folded.select(*KEY, "first.candidate_id", "first.name", F.col("first.seen_at").alias("first_seen_at"), "last_seen_at", "sightings")
