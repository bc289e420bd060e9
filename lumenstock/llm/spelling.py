"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's vector counts its letters by group: frequent letters are groups of their own, the rest share a few. Words
stand in a trie whose level l branches by the count of group l. One inserted letter raises one count by one, one
replaced letter raises one count and lowers another, or none if both are of a group; so a depth-first search from a
word's vector carries a budget of one surplus and one deficit, and what the leaves hold is verified letter by letter.
Every pair is found once: the shorter word looks for the longer, and of two words of a length the one whose vector is
smaller looks for the larger, so a deficit is only spent after the surplus.

The top levels of the trie deal the words out: a shard is a node at the least depth at which no node holds more than
`capacity` words (counted by Spark). A word is at home in one shard and visits those its budget reaches, 7 at depth 3.
A shard's search runs on blocks of words. At a leaf, words are compared in full only if one of their halves agrees.

Word counts are folded in tasks before they move, so that a frequent word costs one row per task and fold. Roots
follow forms by doubling; a form has ten times the count, so a chain has fewer than 20 words and needs five rounds.

Null and empty texts have no words. Rows without an id are left out; rows that repeat an id count again. Words of any
length are taken. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

# Levels of the trie: these letters have groups of their own, others share four by code point.
LETTERS = "etaoinsrhldu"
SHARED = 4
LEVELS = len(LETTERS) + SHARED
# Latin-1 bytes: A-Z in lower case, a-z and 0xC0-0xFF stay, all else separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0xC0 or 97 <= b <= 122 else 32 for b in range(256))
GROUP = np.array([LETTERS.index(chr(b)) if chr(b) in LETTERS else len(LETTERS) + b % SHARED for b in range(256)])
#: Distinct words a task folds before it passes them on.
FOLDED = 500_000
#: States and candidates a search holds at once.
BLOCK = 400_000


def words_of(doc_id: int, text: str, least: int) -> Counter:
    """Counts of a document's words as Latin-1 bytes, after the rule that drops a letter from one run in 31."""
    # Characters beyond Latin-1 become '?', which separates as they do.
    runs = Counter(w for w in text.encode("latin-1", "replace").translate(FOLD).split() if len(w) >= least)
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for w, n in runs.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % 31 == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1:]
            if len(w) < least:
                continue
        out[w] += n
    return out


def _count(least: int):
    def run(batches):
        import pyarrow as pa

        def flush():
            held = list(counts.items())
            for at in range(0, len(held), 20_000):
                w, n = zip(*held[at:at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array([x.decode("latin-1") for x in w]), pa.array(n, pa.int64())], names=["word", "n"])
            counts.clear()

        counts: dict = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w, n in words_of(doc_id, text.as_py(), least).items():
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > FOLDED:
                    yield from flush()
        yield from flush()

    return run


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """Words of all documents with their number of occurrences."""
    counted = documents(docs).mapInArrow(_count(least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- dealing words out ----------------------------------------------------------------------


def _level(word: Column, letter: str) -> Column:
    return F.length(word) - F.length(F.translate(word, letter, ""))


def _node(counts: list[Column]) -> Column:
    return F.concat_ws(".", *counts)


def shard_depth(words: DataFrame, capacity: int) -> int:
    """Least depth at which no node of the trie holds more than `capacity` words, among those with own letters."""
    for depth in range(1, len(LETTERS)):
        node = _node([_level(F.col("word"), c) for c in LETTERS[:depth]])
        largest = words.groupBy(node.alias("node")).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= capacity:
            return depth
    return len(LETTERS)


def _dealt(words: DataFrame, depth: int) -> DataFrame:
    """(shard, visit, word, n): visit 0 at home, 1 with the surplus spent on the way, 2 with both spent."""
    at = [_level(F.col("word"), c) for c in LETTERS[:depth]]
    moved = lambda *changes: _node([c + dict(changes).get(i, 0) for i, c in enumerate(at)])
    stops = [F.struct(_node(at).alias("shard"), F.lit(0).alias("visit"))]
    stops += [F.struct(moved((i, 1)).alias("shard"), F.lit(1).alias("visit")) for i in range(depth)]
    for i in range(depth):
        for j in range(i + 1, depth):
            stops.append(F.when(at[j] > 0, F.struct(moved((i, 1), (j, -1)).alias("shard"), F.lit(2).alias("visit"))))
    return words.select("word", "n", F.explode(F.array_compact(F.array(*stops))).alias("s")).select("s.shard", "s.visit", "word", "n")


# ---- search inside a shard ------------------------------------------------------------------


class Trie:
    """Words at home in a shard, by vector; node numbers of a level are places in its sorted keys."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.vectors = vectors(words)
        self.span = int(self.vectors.max(initial=0)) + 2
        node, self.keys = np.zeros(len(words), np.int64), []
        for level in range(LEVELS):
            keys, node = np.unique(node * self.span + self.vectors[:, level], return_inverse=True)
            self.keys.append(keys)
        self.members = np.argsort(node, kind="stable")
        self.start = np.searchsorted(node[self.members], np.arange(len(self.keys[-1]) + 1))

    def children(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exists, number) of the child with `count` of each node."""
        keys, wanted = self.keys[level], node * self.span + count
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return (keys[at] == wanted) & (count < self.span), at


def vectors(words: list[bytes]) -> np.ndarray:
    text = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(owner * LEVELS + GROUP[text], minlength=len(words) * LEVELS).reshape(-1, LEVELS)


def leaves(trie: Trie, wanted: np.ndarray, visit: np.ndarray):
    """Depth-first search: yields (query, leaf, spent), spent 0 nothing, 1 the surplus, 2 surplus and deficit.

    The stack holds blocks of states of one level; a block that grows past BLOCK is cut, so what is held stays bounded.
    """
    stack = [(0, np.arange(len(wanted)), np.zeros(len(wanted), np.int64), visit)]
    while stack:
        level, query, node, spent = stack.pop()
        if level == LEVELS:
            yield query, node, spent
            continue
        if len(query) > BLOCK:
            for at in range(0, len(query), BLOCK):
                part = slice(at, at + BLOCK)
                stack.append((level, query[part], node[part], spent[part]))
            continue
        count = wanted[query, level]
        more, less = np.flatnonzero(spent == 0), np.flatnonzero((spent == 1) & (count > 0))
        query = np.concatenate([query, query[more], query[less]])
        node = np.concatenate([node, node[more], node[less]])
        spent = np.concatenate([spent, np.ones(len(more), spent.dtype), np.full(len(less), 2, spent.dtype)])
        count = np.concatenate([count, count[more] + 1, count[less] - 1])
        there, child = trie.children(level, node, count)
        if there.any():
            stack.append((level + 1, query[there], child[there], spent[there]))


def _halves(words: list[bytes], drop: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the last half of the words; `drop` letters between them belong to neither."""
    cut = [(len(w) - drop) // 2 for w in words]
    return (np.array([hash(w[:c]) for w, c in zip(words, cut)], np.int64), np.array([hash(w[c + drop:]) for w, c in zip(words, cut)], np.int64))


def one_edit(a: bytes, b: bytes) -> bool:
    """`b` comes from `a` by exactly one inserted or replaced letter."""
    longer = len(b) - len(a)
    if a == b or longer not in (0, 1):
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 - longer:] == b[at + 1:]


def near_pairs(home: list[bytes], queries: list[bytes], visit: np.ndarray, depth: int = 0):
    """Pairs (query, home word) of words one edit apart; a query at home (visit 0) must be a home word too.

    All home words agree on the first `depth` counts; a query's visit tells what it spent to agree as well.
    """
    if not home or not queries:
        return
    trie = Trie(home)
    wanted = vectors(queries)
    wanted[:, :depth] = trie.vectors[0, :depth]
    # Replacement: one half of both words agrees. Insertion: so it does once a letter of the longer is left out.
    home_same, home_longer, asked = _halves(home, 0), _halves(home, 1), _halves(queries, 0)
    for query, leaf, spent in leaves(trie, wanted, visit):
        size = trie.start[leaf + 1] - trie.start[leaf]
        ends = np.cumsum(size)
        low = 0
        while low < len(query):
            # Cuts between states; one leaf may be larger than BLOCK, and is then held alone.
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, side="right")))
            part, n = slice(low, high), size[low:high]
            i = np.repeat(query[part], n)
            j = trie.members[np.repeat(trie.start[leaf[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            longer = np.repeat(spent[part] == 1, n)
            agrees = np.where(longer, (asked[0][i] == home_longer[0][j]) | (asked[1][i] == home_longer[1][j]),
                              (asked[0][i] == home_same[0][j]) | (asked[1][i] == home_same[1][j]))
            same = np.repeat(spent[part] == 0, n)
            for q, h, s in zip(i[agrees].tolist(), j[agrees].tolist(), same[agrees].tolist()):
                a, b = queries[q], home[h]
                # Words of one vector meet from both sides; the smaller one counts.
                if (not s or a < b) and one_edit(a, b):
                    yield q, h
            low = high


def _search(depth: int):
    """Task: rows come sorted by shard; a shard is searched when it is complete."""
    import pyarrow as pa

    def done(rows):
        out: list = []
        home = [k for k, v in enumerate(rows["visit"]) if v == 0]
        if home:
            words = [w.encode("latin-1") for w in rows["word"]]
            n = rows["n"]
            for q, h in near_pairs([words[k] for k in home], words, np.array(rows["visit"], np.int64), depth):
                h = home[h]
                out.append((rows["word"][q], n[q], rows["word"][h], n[h]))
        for at in range(0, len(out), 20_000):
            cols = list(zip(*out[at:at + 20_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["a", "a_n", "b", "b_n"])

    def run(batches):
        shard, held = None, {"visit": [], "word": [], "n": []}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = table.column("shard").to_pylist()
            cuts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != shard:
                    yield from done(held)
                    shard, held = names[a], {"visit": [], "word": [], "n": []}
                for c, values in held.items():
                    values.extend(table.column(c).slice(a, b - a).to_pylist())
        yield from done(held)

    return run


def near_words(words: DataFrame, capacity: int = 30_000) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words one edit apart, once."""
    depth = shard_depth(words, capacity)
    return _dealt(words, depth).repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(depth), "a string, a_n long, b string, b_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of `forms(word, form)`, by doubling."""
    links = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = 10, capacity: int = 30_000) -> DataFrame:
    """Every word with its form (the near word of largest count, if `ratio` times its own) and its root."""
    words = stored(vocabulary(docs), "words")
    pairs = near_words(words, capacity)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = pairs.select(F.explode(sides).alias("p")).select("p.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("top"))
    fits = -F.col("top.minus") >= ratio * F.col("n")
    known = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("top.near")).alias("form"), F.when(fits, -F.col("top.minus")).alias("form_n")), "near-words")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
