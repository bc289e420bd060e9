"""Materialised steps inside a job that reads one intermediate result several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`, or else a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write a step as Parquet in the shared folder and read it back, with the session's compression or `codec`.

    Later reads prune columns and plan with true sizes, the lineage is cut, and a lost executor
    costs a re-read instead of a recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
