"""Byte-level BPE encoding and decoding on padded matrices.

Texts are cut into pieces by the public pattern. New pieces are put into length buckets, one padded matrix of ids
for each; in every round each row merges its leftmost pair of least rank, the ranks coming from a hashed pair table,
the row closes up, and finished rows leave the matrix. Pieces longer than LONGEST bytes would need a round for every
merge over a very wide row and are merged by a heap of pairs instead, with the same result.

Null texts are empty (no ids). Rows without an id are left out; rows that repeat an id are encoded each.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame

from .chunks import Encodings, default_path, encode_texts
from .common import documents

LONGEST = 256
NONE = np.int32(2**31 - 1)


class PairTable:
    """Ranks of pairs of ids by open addressing with a multiplicative hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            took = left[free]
            self.keys[at[free]] = keys[took]  # of several for a slot, the last stays
            won = np.zeros(len(left), bool)
            won[free] = self.keys[at[free]] == keys[took]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key, NONE where there is none."""
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (held != -1)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        from public_tokenizers import PATTERN

        self.find = regex.compile(PATTERN).findall
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.decimal = {i: str(i).encode() for i in self.bytes_of}
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.pieces = Encodings(self._encode_pieces)
        self.chunks = Encodings(self._encode_chunks)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.get((left.astype(np.int64) << 32 | right).ravel()).reshape(left.shape)

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length (two bytes at least)."""
        width = max(map(len, pieces))
        lengths = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = self.byte_id[flat]
        columns = np.arange(width)
        ids[columns[None, :] >= lengths[:, None]] = -1
        ranks = np.full(ids.shape, NONE, np.int32)
        inside = columns[None, :-1] < lengths[:, None] - 1
        ranks[:, :-1][inside] = self.pairs.get((ids[:, :-1][inside].astype(np.int64) << 32) | ids[:, 1:][inside])
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the least
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for r, row, n in zip(rows[done], ids[done], lengths[done]):
                    out[r] = row[:n]
                go = ~done
                rows, ids, ranks, lengths, at, best = rows[go], ids[go], ranks[go], lengths[go], at[go], best[go]
                if not len(rows):
                    break
                width = int(lengths.max())
                ids, ranks, columns = ids[:, :width], ranks[:, :width], columns[:width]
            k = np.arange(len(rows))
            ids[k, at] = best
            shift = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            ids[k, lengths - 1], ranks[k, lengths - 1] = -1, NONE
            lengths = lengths - 1
            ranks[k, lengths - 1] = NONE
            right = at < lengths - 1
            ranks[k[right], at[right]] = self._rank(ids[k[right], at[right]], ids[k[right], at[right] + 1])
            left = at > 0
            ranks[k[left], at[left] - 1] = self._rank(ids[k[left], at[left] - 1], ids[k[left], at[left]])
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long piece, by a heap of (rank, place)."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or self.ranks.get(parts[i] + parts[j]) != rank:
                continue  # one of the two has changed since
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (r := self.ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(queue, (r, a))
        return np.array([self.ranks[p] for p in parts if p], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONGEST:
                out[i] = self._heap(p)
            else:
                buckets.setdefault(len(p).bit_length(), []).append(i)
        for members in buckets.values():
            rows = max(64, 400_000 // max(len(pieces[i]) for i in members))
            for at in range(0, len(members), rows):
                some = members[at:at + rows]
                for i, ids in zip(some, self._matrix([pieces[i] for i in some])):
                    out[i] = ids
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [ids.astype("<u4").tobytes() for ids in self.encode_pieces([p.encode() for p in pieces])]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as bytes."""
        cut = [[(p,) for p in self.find(c)] for c in chunks]
        self.pieces.learn(cut)
        return [b"".join(map(self.pieces.__getitem__, c)) for c in cut]

    def encode(self, texts: list[str]):
        """Ids of each text, text by text."""
        for ids in encode_texts(self.chunks, texts):
            yield np.frombuffer(ids, "<u4")

    def decimals(self, ids: np.ndarray) -> bytes:
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array), decoded (the bytes the ids stand for)."""
    path = path or default_path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for batch in batches:
            ids = list(bpe.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimals joined by commas), decoded_sha256."""
    path = path or default_path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for batch in batches:
            rows = [(len(i), hashlib.sha256(bpe.decimals(i)).hexdigest(), hashlib.sha256(bpe.decode(i)).hexdigest()) for i in bpe.encode(batch.column(1).to_pylist())]
            n, coded, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
