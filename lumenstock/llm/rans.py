"""Token ids in a compressed binary format: range asymmetric numeral systems with shared, static frequencies.

The file format is a table in the shared folder with two kinds of rows. `table` rows hold the frequency table all
blocks share (symbol ids and their slots out of 2**SCALE). `block` rows hold consecutive documents: ids and lengths
of the documents, the number of ids before them, the coded words, one checkpoint for each segment (its first word and the states of its lanes) and
two checksums, of the coded bytes and of the decoded ids. Blocks are independent and a segment can be decoded from
its checkpoint alone, so readers split a file by block and decode all segments of a block side by side.

Coder: 64-bit states in [2**31, 2**63), 32-bit words. A segment is at most STEPS x LANES symbols; lane `l` takes symbols
`l, LANES + l, ...`; the words of a segment stand in decoding order.

Null texts are empty (one end id). Rows without an id are left out; rows that repeat an id follow each other. An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import shared_folder
from .chunks import default_path, encode_texts, library_encodings
from .common import documents, stored

SCALE, LANES, STEPS = 20, 32, 512
LOW, MASK, WORD = np.uint64(1 << 31), np.uint64((1 << SCALE) - 1), np.uint64(32)
BLOCK = "kind string, part int, block long, start long, doc_ids binary, lengths binary, n long, words binary, starts binary, states binary, steps int, coded_crc long, ids_crc long, symbols binary, slots binary"


def frequencies(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Slots of each symbol: in proportion to its count, at least one, 2**SCALE together."""
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more symbols than slots")
    slots = np.maximum(1, (counts / counts.sum() * total).astype(np.int64))
    order = np.argsort(-slots, kind="stable")
    short = total - int(slots.sum())
    if short > 0:
        slots[order[0]] += short
    while short < 0:  # take from the most frequent
        for i in order:
            take = min(-short, max(0, int(slots[i]) // 2))
            slots[i] -= take
            short += take
            if short == 0:
                break
    return slots


class Coder:
    def __init__(self, symbols: np.ndarray, slots: np.ndarray):
        self.symbols = symbols.astype("<u4")
        self.freq = slots.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(slots)[:-1]]).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(symbols), dtype=np.int32), slots)
        self.index = np.full(int(symbols.max()) + 1 if len(symbols) else 1, -1, np.int32)
        self.index[symbols] = np.arange(len(symbols), dtype=np.int32)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Words, first word of each segment, lane states of each segment, steps."""
        n = len(ids)
        segments = max(1, -(-n // (LANES * STEPS)))
        steps = max(1, -(-n // (segments * LANES)))  # at most STEPS
        codes = np.full(segments * steps * LANES, int(np.argmax(self.freq)), np.int32)
        codes[:n] = self.index[ids]
        if n and codes.min() < 0:
            raise ValueError("an id that the table lacks")
        codes = codes.reshape(segments, steps, LANES)
        x = np.full((segments, LANES), LOW, np.uint64)
        words, put = np.zeros((segments, steps, LANES), "<u4"), np.zeros((segments, steps, LANES), bool)
        limit = self.freq << np.uint64(63 - SCALE)
        for t in range(steps - 1, -1, -1):
            s = codes[:, t]
            f = self.freq[s]
            full = x >= limit[s]
            put[:, t] = full
            words[:, t] = x.astype("<u4")
            x = np.where(full, x >> WORD, x)
            q = x // f
            x = (q << np.uint64(SCALE)) + (x - q * f) + self.cum[s]
        starts = np.concatenate([[0], np.cumsum(put.sum((1, 2)))[:-1]]).astype("<u4")
        return words[put], starts, x, steps

    def decode(self, words: np.ndarray, starts: np.ndarray, states: np.ndarray, steps: int) -> np.ndarray:
        """Ids of the given segments, side by side; any subset of a block's checkpoints will do."""
        x, at = states.copy(), starts.astype(np.int64)
        out = np.empty((len(starts), steps, LANES), np.int32)
        words = np.append(words, np.zeros(1, "<u4")).astype(np.uint64)
        last = len(words) - 1
        for t in range(steps):
            slot = x & MASK
            s = self.of_slot[slot.astype(np.int64)]
            out[:, t] = s
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.cum[s]
            low = x < LOW
            read = np.cumsum(low, 1)
            take = words[np.minimum(at[:, None] + read - 1, last)]
            x = np.where(low, (x << WORD) | take, x)
            at += read[:, -1]
        return self.symbols[out.reshape(-1)]


def _tokenise(path: str, end_id: int):
    def run(batches):
        import pyarrow as pa

        learned = library_encodings(path)
        end, seq, at = np.array([end_id], "<u4").tobytes(), 0, 0
        for batch in batches:
            part, doc_id, text = (batch.column(i).to_pylist() for i in range(3))
            ids = [i + end for i in encode_texts(learned, text)]
            after = at + np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(range(seq, seq + len(part)), pa.int64()), pa.array(after, pa.int64()), pa.array(doc_id, pa.int64()), pa.array([_narrow(i) for i in ids], pa.binary())], names=["part", "seq", "after", "doc_id", "ids"])
            seq, at = seq + len(part), int(after[-1]) if len(after) else at
        learned.forget()

    return run


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where all fit (then a leading 2), else four (a leading 4)."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x04" + ids if wide.max() > 0xFFFF else b"\x02" + wide.astype("<u2").tobytes()


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype("<u4")


def _count(batches):
    import pyarrow as pa

    counts = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column(0).to_pylist():
            got = np.bincount(_wide(ids), minlength=len(counts))
            got[:len(counts)] += counts
            counts = got
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["symbol", "n"])


def _encode(symbols: bytes, slots: bytes, part_starts: dict[int, int], block_ids: int):
    def run(batches):
        import pyarrow as pa

        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in BLOCK.split(", "))])
        coder = Coder(np.frombuffer(symbols, "<u4"), np.frombuffer(slots, "<u4").astype(np.int64))
        held: list[tuple[int, int, np.ndarray]] = []
        size, part, first, start = 0, None, 0, 0

        def block():
            ids = np.concatenate([h[1] for h in held])
            words, starts, states, steps = coder.encode(ids)
            row = ["block", part, first, start, np.array([h[0] for h in held], "<i8").tobytes(), np.array([len(h[1]) for h in held], "<i8").tobytes(), len(ids),
                   words.tobytes(), starts.tobytes(), states.astype("<u8").tobytes(), steps, zlib.crc32(words.tobytes()), zlib.crc32(ids.tobytes()), None, None]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for p, seq, after, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != part or size >= block_ids):
                    yield block()
                    held, size = [], 0
                wide = _wide(ids)
                if not held:
                    part, first, start = p, seq, part_starts[p] + after - len(wide)
                held.append((doc_id, wide))
                size += len(wide)
        if held:
            yield block()

    return run


def _decode(symbols: bytes, slots: bytes):
    def run(batches):
        import pyarrow as pa

        coder = Coder(np.frombuffer(symbols, "<u4"), np.frombuffer(slots, "<u4").astype(np.int64))
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["words"]) != row["coded_crc"]:
                    raise ValueError(f"damaged block {row['part']}/{row['block']}")
                states = np.frombuffer(row["states"], "<u8").reshape(-1, LANES)
                ids = coder.decode(np.frombuffer(row["words"], "<u4"), np.frombuffer(row["starts"], "<u4"), states, row["steps"])[:row["n"]]
                if zlib.crc32(ids.tobytes()) != row["ids_crc"]:
                    raise ValueError(f"block {row['part']}/{row['block']} decodes to other ids")
                lengths = np.frombuffer(row["lengths"], "<i8")
                after = np.cumsum(lengths)
                before = after - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64()), pa.array(row["start"] + before, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(before, after)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 0, block_ids: int = 1 << 20) -> str:
    """Encode every text, in ascending order of doc_id, and write the format; returns its folder.

    `path`: vocabulary of the tokenizers library. `block_ids`: ids after which a block ends, at a document's end.
    """
    spark = docs.sparkSession
    path = path or default_path("byte_bpe_50k.json")
    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    tokens = stored(ordered.mapInArrow(_tokenise(path, end_id), "part int, seq long, after long, doc_id long, ids binary"), "token-ids")
    sizes = sorted((r[0], r[1]) for r in tokens.groupBy("part").agg(F.max("after")).collect())  # one row for each written partition
    part_starts, total = {}, 0
    for part, n in sizes:
        part_starts[part], total = total, total + n
    counts = tokens.select("ids").mapInArrow(_count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    known = sorted((r[0], r[1]) for r in counts.collect())  # at most the vocabulary
    symbols = np.array([k for k, _ in known], "<u4")
    slots = frequencies(symbols, np.array([n for _, n in known], np.int64)).astype("<u4") if known else symbols
    folder = f"{shared_folder(spark)}/token-file-{uuid.uuid4().hex}"
    head = [("table", -1, -1, *[None] * 10, symbols.tobytes(), slots.tobytes())]
    blocks = tokens.mapInArrow(_encode(symbols.tobytes(), slots.tobytes(), part_starts, block_ids), BLOCK)
    blocks.write.option("compression", "none").parquet(folder)
    spark.createDataFrame(head, BLOCK).coalesce(1).write.option("compression", "none").mode("append").parquet(folder)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits)."""
    rows = spark.read.schema(BLOCK).parquet(folder)
    head = rows.where("kind = 'table'").select("symbols", "slots").first()
    decode = _decode(bytes(head[0]), bytes(head[1]))
    return rows.where("kind = 'block'").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Write `docs`, read the files back: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(docs.sparkSession, write_tokens(docs, **options)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
