"""Shared steps of the operators: inputs, stored steps, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import shared_folder


def documents(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` of a table, whatever else it has; a null text is empty, rows without an id are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a step to the shared folder and read it back: lineage is cut and lost executors cost a re-read."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(batches, rows: int = 500):
    """The rows of a task's batches in short ones: texts are unpacked a few at a time, so a worker's memory follows these."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    tidy()


def tidy() -> None:
    """Give back what a finished task has freed: a worker lives on for other tasks and would keep it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """The fold no label is learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most `limit` labelled rows outside the held-out fold, spread by a hash of the id: (doc_id, text, label).

    This bound is the only one of the classifiers; scores and statistics of scores cover all rows. The ids are
    chosen before texts move, so the join reads few texts. Null labels are ignored; of an id labelled twice the
    larger label counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(label)), "doc_id").limit(limit)
    return documents(docs).join(F.broadcast(chosen), "doc_id")  # at most `limit` rows of 12 bytes


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`(node, component)` for every node of `edges(a, b)`; the component is its smallest node.

    Alternating large and small stars: every node points to the least neighbour, until nothing changes. Each step
    is a `min` aggregate, combined before its shuffle, and a join back that adaptive execution may split, so a hub
    of any degree is spread over tasks. Every round is stored in the shared folder.
    """
    edges = stored(_oriented(edges), "edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = _oriented(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = stored(_oriented(small), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    """Larger node first, loops and repeats gone."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """One row that tells two edge tables apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
