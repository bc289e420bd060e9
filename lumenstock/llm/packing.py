"""Packing documents into training sequences by minimum bin slack.

A document's ids and an end id form its tokens; only documents over the capacity are cut, into full pieces and a
rest. A sequence starts with the longest piece left; a bitset subset-sum over the lengths still available finds
the fullest combination for the remaining room, and that combination is removed. Pieces of one length are
interchangeable, so the search runs over counts by length: a found combination is used as often as the counts allow.
The search's input is at most `capacity` counts and each combination uses up (all but a few of) some length's
pieces, so its work and the table of combinations depend on the capacity and not on the number of documents. Spark
numbers the pieces of each length, spread over the parts of the stored table, and every piece looks up its place.

Null texts are empty and still have their end id. Rows without an id are left out; rows that repeat an id are packed
each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import default_path, encode_texts, library_encodings
from .common import documents, small, stored

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(room: int, available: list[tuple[int, int]]) -> list[int]:
    """Lengths, among `(length, count)` in descending order, whose sum is the largest not over `room`."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length, count in available:
        if length > room:
            continue
        for _ in range(min(count, room // length)):
            more = reach | (reach << length & mask)
            if more == reach:
                break
            layers.append((length, reach))
            reach = more
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """`(uses, {length: copies})` that together use every piece."""
    left = {k: n for k, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        first = order[0]
        left[first] -= 1
        chosen = fullest(capacity - first, [(k, left[k]) for k in order if left[k]]) if first < capacity else []
        left[first] += 1
        copies = {first: 1}
        for k in chosen:
            copies[k] = copies.get(k, 0) + 1
        uses = min(left[k] // c for k, c in copies.items())
        for k, c in copies.items():
            left[k] -= uses * c
        out.append((uses, copies))
        order = [k for k in order if left[k]]
    return out


def places(found: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, copies a sequence, first sequence, offset of the first copy), by rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for uses, copies in found:
        offset = 0
        for length, c in copies.items():
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, c, sequence, offset))
            used[length] = rank + uses * c
            offset += length * c
        sequence += uses
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        learned, end = library_encodings(path), np.array([end_id], "<u4").tobytes()
        for batch in small(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(learned, batch.column(1).to_pylist())):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        learned.forget()

    return documents(docs).mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, path or default_path("word_bpe_49k.json"), capacity, end_id)
    cut = stored(cut.withColumn("part", F.spark_partition_id()), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    table = places(combinations(by_length, capacity))
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    local = cut.withColumn("rank", F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = local.join(before, ["length", "part"]).select(*[c.split()[0] for c in PIECE.split(", ")], (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                at, rows = length == size, table[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                since = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + since // row[:, 1]
                offset[at] = row[:, 3] + since % row[:, 1] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECE}, sequence_id long, offset long")
