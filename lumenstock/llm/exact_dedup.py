"""Exact duplicates by an extendible-hash index on shared files.

A document's key is a 64-bit hash of its text. The directory maps the leading bits of a key to a bucket; a bucket
over its capacity splits on its next bit, and when its depth reaches the directory's, the directory doubles.
Buckets are contiguous key ranges; an owner task takes some of them, sorts their entries by key, chains the
entries of a key and compares their bytes. The index (key, place in chain, text, surviving id, count) is written to
the shared folder.

Hot texts: every task folds its own copies before anything moves, so a text crosses the network at most once per
task and fold, whatever share of the rows it has. Only bucket sizes, at most 2**max_depth, reach the driver.

Null texts are empty texts and equal each other. Rows without an id are left out. Rows that repeat an id count as
rows of their own; all rows of the surviving id are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

ENTRY = "key long, text string, sha binary, keep_id long, n long"


def directory(sizes: dict[int, int], bits: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Depth of the directory and its buckets as (prefix, depth), in key order.

    `sizes`: bytes by the first `bits` bits of the key. A bucket over `capacity` splits until it has all bits; what
    is still too large then stays one long bucket, whose entries are chained.
    """
    depth, done, todo = 0, [], [(0, 0, dict(sizes))]
    while todo:
        prefix, d, held = todo.pop()
        if sum(held.values()) <= capacity or d == bits:
            done.append((prefix, d))
            continue
        if d == depth:
            depth += 1
        bit = bits - d - 1
        for side in (1, 0):
            todo.append((prefix * 2 + side, d + 1, {k: v for k, v in held.items() if (k >> bit) & 1 == side}))
    return depth, done


def _fold(limit: int):
    """One row per distinct text of a task, or of `limit` bytes of texts."""
    def run(batches):
        import pyarrow as pa

        def out():
            rows = [(k, t, s, i, n) for (k, t), (s, i, n) in held.items()]
            names = ["key", "text", "sha", "keep_id", "n"]
            types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            for at in range(0, len(rows), 2000):
                cols = list(zip(*rows[at:at + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        held, size = {}, 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = held.get((key, text))
                if at is None:
                    data = text.encode("utf-8", "surrogatepass")
                    held[key, text] = (hashlib.sha256(data).digest(), doc_id, 1)
                    size += len(data)
                else:
                    held[key, text] = (at[0], max(at[1], doc_id), at[2] + 1)
            if size > limit:
                yield from out()
                held, size = {}, 0
        yield from out()

    return run


def _chain(batches):
    """Entries of a task in key order: one entry per text; entries of one key are told apart by their bytes."""
    import pyarrow as pa

    names = ["bucket", "key", "chain", "text", "sha", "keep_id", "n"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    rows: list[tuple] = []
    key, chain, size = None, [], 0

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for entry in zip(*(c.to_pylist() for c in batch.columns)):
            bucket, now, text, sha, keep, n = entry
            if now != key:
                rows += [(b, k, i, *rest) for i, (b, k, *rest) in enumerate(chain)]
                size += sum(len(c[2]) for c in chain)
                key, chain = now, []
                if size > 16_000_000:
                    yield pack(rows)
                    rows, size = [], 0
            for link in chain:
                if link[2] == text:
                    link[4], link[5] = max(link[4], keep), link[5] + n
                    break
            else:
                chain.append([bucket, now, text, sha, keep, n])
    rows += [(b, k, i, *rest) for i, (b, k, *rest) in enumerate(chain)]
    if rows:
        yield pack(rows)


def build_index(docs: DataFrame, capacity: int = 16 << 20, max_depth: int = 20, owners: int = 4096, fold_bytes: int = 48 << 20) -> tuple[DataFrame, DataFrame]:
    """The index and the entry of every row: `(bucket, key, chain, text, sha, keep_id, n)` and `(row, doc_id, key, sha, size)`.

    `capacity`: text bytes of a bucket. `max_depth`: most bits of the directory. `owners`: most owner tasks, each with
    neighbouring buckets.
    """
    texts = documents(docs).withColumn("key", F.xxhash64("text"))
    rows = stored(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("size")), "dedup-rows")
    prefix = F.shiftrightunsigned(F.col("key"), 64 - max_depth)
    once = rows.groupBy("key").agg(F.max("size").alias("size"))
    sizes = {r[0]: r[1] for r in once.groupBy(prefix.alias("p")).agg(F.sum("size")).collect()}  # at most 2**max_depth
    depth, buckets = directory(sizes, max_depth, capacity)
    spark = docs.sparkSession
    slots = [(p << (depth - d) | i, b) for b, (p, d) in enumerate(buckets) for i in range(1 << (depth - d))]
    slot = F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")
    folded = texts.select("doc_id", "key", "text").mapInArrow(_fold(fold_bytes), ENTRY).withColumn("slot", slot)
    placed = folded.join(F.broadcast(spark.createDataFrame(slots, "slot long, bucket long")), "slot")  # at most 2**max_depth rows
    tasks = min(owners, len(buckets))
    owner = F.expr(f"CAST(bucket * {tasks} DIV {len(buckets)} AS INT)")
    owned = placed.select("bucket", "key", "text", "sha", "keep_id", "n").repartitionById(tasks, owner)
    chained = owned.sortWithinPartitions("bucket", "key").mapInArrow(_chain, "bucket long, key long, chain int, text string, sha binary, keep_id long, n long")
    return stored(chained, "dedup-index"), rows


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id (largest id of the same text), group_size, kept, text_sha256."""
    index, rows = build_index(docs, **options)
    stays = rows.groupBy("key", "sha").agg(F.max(F.struct("doc_id", "row")).alias("stays"))
    entries = index.select("key", "sha", "keep_id", "n").join(stays, ["key", "sha"])
    found = rows.join(entries, ["key", "sha"])
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("stays.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
