"""Replaying a table as a stream of files, one slice of time after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replay(rows: DataFrame, time: str, slices: int, folder: str, start: Callable[[DataFrame], StreamingQuery], again: DataFrame | None = None) -> list:
    """Deliver `rows` in `slices` equal spans of `time`, running the query to its end after each; progress of all batches.

    Each slice is one micro-batch, whatever number of files it takes; the query goes on from its checkpoint. `again`:
    rows of the same columns that are delivered once more, each in the slice after its own.
    """
    instant = F.unix_micros(F.col(time).cast("timestamp"))
    first, last = rows.agg(F.min(instant), F.max(instant)).first()
    place = lambda df, shift: df.withColumn("_slice", F.least(F.floor((instant - F.lit(first)) * slices / F.lit(max(last - first, 1) + 1)), F.lit(slices - 1)) + shift)
    dealt = place(rows, 0) if again is None else place(rows, 0).unionByName(place(again, 1))
    progress: list = []
    for i in range(slices + (again is not None)):
        dealt.where(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(folder)
        query = start(rows.sparkSession.readStream.schema(rows.schema).parquet(folder))
        query.awaitTermination()
        progress += query.recentProgress
    return progress
