"""Uniform shuffle of documents into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows are written once in their source partitions, numbered from 0 in each; the sizes of the partitions are the
   only thing the driver sees.
2. Shards are cut into blocks of bounded row counts. The matrix says how many rows of each source go to each block;
   its rows are drawn from the multivariate hypergeometric law, so block sizes come out exact and every assignment of
   rows to places has the same chance. Every task draws the row of its own source only: sources are halved again and
   again, and each half takes its share of the blocks' places by a draw seeded by that half, so all tasks that pass
   the same half agree, and a task that is run again draws the same row.
3. A source permutes its targets over its rows, rows are exchanged by block, and every block is permuted again by
   independent random keys. A row's slot is its block's first slot plus its place in the block.

No key of the data takes part in the exchange: copies, sources and very long texts spread like any other rows.
Null texts are empty texts. Rows without an id are left out; rows that repeat an id are rows of their own. An empty
table gives an empty result; fewer rows than shards leave shards empty. Other columns are not carried.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

SEED = 20_240
#: monotonically_increasing_id puts the partition above and the row number below this bit.
ROW_BITS = 33
#: numpy draws from populations below this size.
SMALL = 1_000_000_000
PLACED = "doc_id long, text string, row long, shard int, target int, first long, key long"


def block_sizes(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, shard, first slot) of every block; shards and the blocks of a shard differ by one row at most."""
    size, shard, first = [], [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        blocks = max(1, -(-n // block_rows))
        cut = n // blocks + (np.arange(blocks) < n % blocks)
        size.append(cut)
        shard.append(np.full(blocks, s))
        first.append(np.cumsum(cut) - cut)
    return np.concatenate(size), np.concatenate(shard), np.concatenate(first)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among `n` drawn from a population of any size."""
    if good + bad < SMALL:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean, spread = n * (good / total), (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5
    low, high = max(0, n - bad, int(mean - 12 * spread) - 20), min(n, good, int(mean + 12 * spread) + 20)
    k = np.arange(low, high, dtype=np.float64)
    # Logarithms of the ratios of neighbouring probabilities; what lies 12 deviations out is beyond double precision.
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def draw(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """How many of `n` rows take a place of each block, all places being equally likely."""
    if int(places.sum()) < SMALL:
        return rng.multivariate_hypergeometric(places, n, method="marginals")
    half = len(places) // 2
    left = hypergeometric(rng, int(places[:half].sum()), int(places[half:].sum()), n)
    return np.concatenate([draw(rng, places[:half], left), draw(rng, places[half:], n - left)])


def matrix_row(source: int, ends: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Row of the communication matrix. `ends`: running row counts of the sources, from 0."""
    low, high = 0, len(ends) - 1
    while high - low > 1:
        middle = (low + high) // 2
        left = draw(np.random.default_rng([seed, 0, low, high]), places, int(ends[middle] - ends[low]))
        if source < middle:
            places, high = left, middle
        else:
            places, low = places - left, middle
    return places


def _place(partitions: list[int], counts: list[int], shards: int, block_rows: int, seed: int):
    """Task: target block and random key of every row."""
    def run(batches):
        import pyarrow as pa

        ends = np.concatenate([[0], np.cumsum(counts)])
        number = {p: i for i, p in enumerate(partitions)}
        sizes, shard, first = block_sizes(int(ends[-1]), shards, block_rows)

        @functools.lru_cache(2)
        def source(part):
            i = number[part]
            rng = np.random.default_rng([seed, 1, i])
            targets = rng.permutation(np.repeat(np.arange(len(sizes)), matrix_row(i, ends, sizes, seed)))
            return targets, rng.integers(0, 1 << 63, len(targets), dtype=np.int64)

        for batch in batches:
            row = batch.column(2).to_numpy()
            part, at = row >> ROW_BITS, row & ((1 << ROW_BITS) - 1)
            target, key = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
            for p in np.unique(part):
                here = part == p
                targets, keys = source(int(p))
                target[here], key[here] = targets[at[here]], keys[at[here]]
            more = [pa.array(shard[target].astype(np.int32)), pa.array(target.astype(np.int32)), pa.array(first[target]), pa.array(key)]
            yield pa.RecordBatch.from_arrays(batch.columns + more, names=["doc_id", "text", "row", "shard", "target", "first", "key"])

    return run


def shuffled_shards(docs: DataFrame, shards: int = 24, seed: int = SEED, block_rows: int = 1 << 16) -> DataFrame:
    """Every document with its `shard` and gapless `slot`: a uniform permutation, shard sizes at most one row apart.

    `block_rows` bounds the rows that are permuted in one sort, not the shard.
    """
    if shards < 1 or block_rows < 1:
        raise ValueError("shards and block_rows must be positive")
    rows = stored(documents(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "shard-rows")
    held = rows.groupBy(F.shiftright("row", ROW_BITS).alias("part")).count().orderBy("part").collect()  # one row per written partition
    place = _place([r["part"] for r in held], [r["count"] for r in held], shards, block_rows, seed)
    placed = rows.mapInArrow(place, PLACED)
    within = F.row_number().over(Window.partitionBy("target").orderBy("key", "row"))
    return placed.select("doc_id", "text", "shard", (F.col("first") + within - 1).alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, rows in slot order inside every file."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digests(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard, slot, size in bytes and checksum of every document."""
    return shuffled_shards(docs, shards).select(
        "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
