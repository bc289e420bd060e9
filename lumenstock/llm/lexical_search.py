"""Ranked lexical search: term at a time with a limited number of accumulators.

Pass 1 reads every text once and stores, per document, its number of terms and its counts of the terms the items
ask for. Corpus statistics (documents, terms, documents per term) are aggregates of that table. In pass 2 every task
inverts a slice of it and scores the items one by one: postings are read rarest term first; a document new to an item
gets an accumulator only while the bounds of this and all later terms could still bring it to the item's k-th partial
score; from there on only documents that have one are updated, exactly, by every later term. The k-th score an item
has reached carries over to the task's next slices. A task gives its k best documents of every item, and the k best of
those are the answer, so no pruning is ever approximate.

Items go through in blocks of at most `block_terms` wanted terms; those of one block are what a task holds. A block
is one more pass over the texts. Nothing of the documents reaches the driver but two totals and a count per wanted
term.

Null texts have no terms. Documents and items without an id are left out; rows that repeat a document id are
documents of their own, rows that repeat an item id are one item. Items without terms, or whose terms are nowhere,
have no rows; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

# A-Z in lower case; digits, letters and every byte of a non-ASCII character stay; all else separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEXED = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item_id long, doc_id long, score long"
#: Postings inverted at once in a task.
SLICE = 2_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_blocks(items: DataFrame, limit: int):
    """Blocks of items as {item_id: terms}, with at most `limit` terms in a block (or one item)."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block: dict[int, set] = {}
    held = 0
    for r in rows.orderBy("item_id").toLocalIterator():
        wanted = set(terms_of(r["text"].encode()))
        if r["item_id"] not in block and block and held + len(wanted) > limit:
            yield block
            block, held = {}, 0
        new = wanted - block.setdefault(r["item_id"], set())
        block[r["item_id"]] |= new
        held += len(new)
    if block:
        yield block


def _index(number: dict[bytes, int]):
    """Task: number of terms of every document, and counts of the wanted ones."""
    def run(batches):
        import pyarrow as pa

        get = number.get
        for batch in batches:
            n, ends, terms, counts = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms_of(text.as_py())
                n.append(len(words))
                found = Counter(map(get, words))
                found.pop(None, None)
                terms.extend(found)
                counts.extend(found.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


def _slices(lengths: np.ndarray):
    """Ranges of neighbouring documents with about SLICE postings together."""
    part = (np.cumsum(lengths) - lengths) // SLICE
    cuts = np.flatnonzero(np.diff(part)) + 1
    return zip([0, *cuts], [*cuts, len(lengths)])


class Slice:
    """Postings of some documents by term: documents and impacts, with the largest impact of each term."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, doc: np.ndarray, length_norm: np.ndarray, n_terms: int):
        order = np.argsort(terms, kind="stable")
        self.doc, tf = doc[order], counts[order].astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * length_norm[self.doc])
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.best = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.best[held] = np.maximum.reduceat(self.impact, self.start[held])


def accumulate(s: Slice, n_docs: int, terms: list[int], weights: np.ndarray, k: int, reached: int) -> np.ndarray:
    """Scores of the documents of a slice for one item, `terms` rarest first; 0 where it got no accumulator.

    `reached`: a score that k documents are known to have; a document that can't reach it may stay at 0.
    """
    scores, created = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    bounds = np.array([weights[t] * s.best[t] for t in terms], np.int64)
    rest = np.cumsum(bounds[::-1])[::-1]
    open_ = True
    for at, t in enumerate(terms):
        a, b = s.start[t], s.start[t + 1]
        if a == b:
            continue
        doc, gain = s.doc[a:b], weights[t] * s.impact[a:b]
        if open_ and rest[at] < reached:
            open_ = False
        if open_:
            created[doc] = True
        else:
            kept = created[doc]
            doc, gain = doc[kept], gain[kept]
        scores[doc] += gain
        if open_ and n_docs >= k:
            reached = max(reached, int(np.partition(scores, n_docs - k)[n_docs - k]))
    return scores


def best_of(doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, equal ones by document id."""
    keep = np.flatnonzero(score > 0)
    if len(keep) > k:
        limit = np.partition(score[keep], len(keep) - k)[len(keep) - k]
        keep = keep[score[keep] >= limit]
    keep = keep[np.lexsort((doc[keep], -score[keep]))][:k]
    return doc[keep], score[keep]


def _search(items: dict[int, list[int]], weights: list[int], n_docs: int, n_terms: int, k: int):
    """Task: the k best documents of every item."""
    def run(batches):
        import pyarrow as pa

        w = np.array(weights, np.int64)
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        best = dict.fromkeys(items, none)
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            norm = 10 + 90 * n * n_docs // n_terms
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            terms, counts = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            shift = batch.column(3).offsets[0].as_py() - ends[0]
            for a, b in _slices(np.diff(ends)):
                p, q = ends[a], ends[b]
                doc = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
                s = Slice(terms[p:q], counts[p + shift:q + shift], doc, norm[a:b], len(w))
                for item, wanted in items.items():
                    old = best[item]
                    reached = int(old[1][-1]) if len(old[1]) == k else 0
                    d, v = best_of(ids[a:b], accumulate(s, b - a, wanted, w, k, reached), k)
                    best[item] = best_of(np.concatenate([old[0], d]), np.concatenate([old[1], v]), k)
        for item, (d, v) in best.items():
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), item, np.int64)), pa.array(d), pa.array(v)], names=["item_id", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, block: dict[int, set], k: int) -> DataFrame:
    words = sorted(set().union(*block.values()))
    number = {w: i for i, w in enumerate(words)}
    index = stored(documents(docs).mapInArrow(_index(number), INDEXED), "term-counts")
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return docs.sparkSession.createDataFrame([], FOUND)
    df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row per wanted term at most
    weights = [weight(n_docs, df[i]) if i in df else 0 for i in range(len(words))]
    items = {i: sorted((number[w] for w in wanted if number[w] in df), key=lambda t: (df[t], t)) for i, wanted in block.items()}
    return index.where("n > 0").mapInArrow(_search(items, weights, n_docs, n_terms, k), FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 200_000) -> DataFrame:
    """The `k` highest-scoring documents of every item: item_id, rank, doc_id, score."""
    parts = [stored(_search_block(docs, block, k), "found") for block in _item_blocks(items, block_terms)]
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], FOUND)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
