"""Ranked search, spelling variants and sharding against brute force, and on odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenstock.llm import lexical_search, sharding, spelling
from tests.llm.support import LONG, no_documents, odd_documents

ITEMS = "item_id long, text string, doc_id long, score double, rank int"


# ---- ranked search ----------------------------------------------------------------------------


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(docs, items, k=10):
    docs = [(i, Counter(words(t))) for i, t in docs if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in docs:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("block_terms", [200_000, 3])
def test_search_is_brute_force(spark, block_terms):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{int(i)}" for i in rng.zipf(1.3, 4000) if i < 500]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(400)]
    docs = [*enumerate(texts), *enumerate(texts[:50], 400), (3, texts[3]), (None, "w1 w2"), (990, None), (991, ""), (992, "Éa É w7-W7 w7\x00w8")]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 12))))) for i in range(30)] + [(2, "w9 W1"), (50, None), (51, " "), (52, "nowhere"), (None, "w1"), (53, "éa Éa É w7")]
    got = found(lexical_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"),
                                             spark.createDataFrame([(*i, 1, 0.5, 2) for i in items], ITEMS), block_terms=block_terms))
    assert got == brute_search(docs, items)


def test_accumulators_are_limited_and_scores_stay_exact():
    """A common term creates nothing once k documents are out of its reach, and still adds to those that have one."""
    terms = np.array([0] * 20 + [1] * 1000, np.int32)
    doc = np.concatenate([np.arange(20), np.arange(1000)])
    s = lexical_search.Slice(terms, np.ones(1020, np.int32), doc, np.full(1000, 100), 2)
    scores = lexical_search.accumulate(s, 1000, [0, 1], np.array([9000, 3]), 10, 0)
    assert (scores > 0).sum() == 20 and scores[0] == 9003 * s.impact[0]


def test_search_takes_several_slices(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 3} c") for i in range(200)]
    items = [(1, "a1 b2 c"), (2, "c"), (3, "a6")]
    monkeypatch.setattr(lexical_search, "SLICE", 50)
    assert len(list(lexical_search._slices(np.full(200, 3)))) > 5
    got = found(lexical_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, 1, 0.5, 2) for i in items], ITEMS)))
    assert got == brute_search(docs, items)


def test_search_takes_odd_tables(spark):
    items = spark.createDataFrame([(1, "Lorem a", 5, 0.1, 1), (2, "日本語 café", 5, 0.1, 1)], ITEMS)
    docs = odd_documents(spark)
    assert found(lexical_search.ranked_search(docs, items)) == brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(1, "Lorem a"), (2, "日本語 café")])
    assert found(lexical_search.ranked_search(no_documents(spark), items)) == []
    assert found(lexical_search.ranked_search(docs, items.limit(0))) == []


# ---- spelling ---------------------------------------------------------------------------------


def brute_vocabulary(docs):
    counts = Counter()
    for doc_id, text in docs:
        if doc_id is None:
            continue
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edits(word, alphabet):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in alphabet}
    return out - {word}


def brute_variants(docs):
    n = brute_vocabulary(docs)
    alphabet = set("".join(n))
    near = {w: [x for x in edits(w, alphabet) if x in n] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def variants(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def chained_documents():
    """Counts of 1200, 120, 12 and 2 in a chain, ties, accents, one-letter runs, and words of equal vectors."""
    text = ["receive " * 1200, "recieve " * 3, "receives " * 120, "receivesx " * 12, "xreceivesx " * 2, "café-crème Éclairée éclairée ÉCLAIRÉE " * 3, "aaaaaaaa " * 5 + "aaaaaaa " * 60, "abcdefgh abcdefhg bacdefgh " * 4]
    text += ["listening glistening listenin " * 5, "w" * 4000 + " " + "w" * 4001 + " " + "w" * 4000 + " " + "w" * 4001, "straße strasse naïveté naivete " * 9, "lowercased LOWERCASED İstanbul×fleuves÷rivieres rivieres fleuves"]
    return [(1000 + i, t) for i, t in enumerate(text)]


@pytest.mark.parametrize("capacity", [30_000, 3])
def test_variants_are_brute_force(spark, capacity):
    rng = np.random.default_rng(3)
    syllables = ["ter", "mi", "na", "lo", "gy", "st", "er", "ing", "é", "ou"]
    base = ["".join(rng.choice(syllables, 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(base, 80)) for _ in range(150)]
    docs = [*enumerate(texts), *chained_documents(), (None, "ignored ignored"), (5, texts[5]), (5000, None), (5001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = variants(spelling.spelling_variants(df, capacity=capacity))
    assert got == brute_variants(docs)
    assert any(r[2] != r[0] and r[1] != r[2] for r in got), "no chain of two"


def test_query_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    assert variants(spelling.spelling_variants(docs, capacity=50)) == brute_variants([tuple(r) for r in docs.collect()])


def test_one_edit():
    rng = np.random.default_rng(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice(list("abc"), int(rng.integers(0, 6)))) for _ in range(2))
        want = b in edits(a, "abc") and len(b) - len(a) in (0, 1)
        assert spelling.one_edit(a.encode(), b.encode()) == want


def test_a_search_cut_into_small_blocks_is_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    home = sorted({"".join(rng.choice(list("aetx"), 7)).encode() for _ in range(400)})
    whole = sorted(spelling.near_pairs(home, home, np.zeros(len(home), np.int64)))
    monkeypatch.setattr(spelling, "BLOCK", 7)
    assert sorted(spelling.near_pairs(home, home, np.zeros(len(home), np.int64))) == whole
    assert len(whole) == sum(a < b and b.decode() in edits(a.decode(), "aetx") for a in home for b in home)


def test_variants_take_odd_tables(spark):
    docs = odd_documents(spark)
    assert variants(spelling.spelling_variants(docs)) == brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert variants(spelling.spelling_variants(no_documents(spark))) == []


# ---- sharding ---------------------------------------------------------------------------------


def texts_by_id(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def placed(docs, **options):
    return sorted(tuple(r) for r in sharding.shuffled_shards(docs, **options).select("doc_id", "shard", "slot").collect())


@pytest.mark.parametrize("rows,shards,block", [(1000, 24, 1 << 16), (1000, 24, 7), (5, 24, 10), (97, 1, 10), (240, 24, 1)])
def test_shards_have_exact_sizes(spark, rows, shards, block):
    docs = spark.range(rows).selectExpr("id AS doc_id", "concat('t', id) AS text").repartition(5)
    out = placed(docs, shards=shards, block_rows=block)
    assert [r[0] for r in out] == list(range(rows))
    sizes = Counter(r[1] for r in out)
    assert sorted((sizes[s] for s in range(shards)), reverse=True) == [rows // shards + (s < rows % shards) for s in range(shards)]
    for s in sizes:
        assert sorted(r[2] for r in out if r[1] == s) == list(range(sizes[s]))


def test_matrix_has_exact_sums():
    counts = np.array([0, 500, 3, 40_000, 77, 1])
    ends = np.concatenate([[0], np.cumsum(counts)])
    sizes, shard, first = sharding.block_sizes(int(ends[-1]), 24, 300)
    matrix = np.array([sharding.matrix_row(i, ends, sizes, 1) for i in range(len(counts))])
    assert (matrix.sum(1) == counts).all() and (matrix.sum(0) == sizes).all() and (matrix >= 0).all()
    assert sizes.max() <= 300 and np.bincount(shard, sizes).max() - np.bincount(shard, sizes).min() <= 1
    assert (sharding.matrix_row(3, ends, sizes, 1) == matrix[3]).all()


def test_every_place_is_as_likely(spark):
    """Chi-square of source partition by shard, and of place by place, over many seeds."""
    ends, hits = np.array([0, 30, 40, 100]), np.zeros((3, 4))
    for seed in range(3000):
        for i in range(3):
            hits[i] += sharding.matrix_row(i, ends, np.full(4, 25), seed)
    want = np.array([30, 10, 60])[:, None] * 3000 / 4
    assert (np.abs(hits - want) / np.sqrt(want) < 4).all()
    docs = spark.range(2400).selectExpr("id AS doc_id", "'x' AS text").repartitionByRange(4, "doc_id")
    out = placed(docs, shards=24, block_rows=40)
    table = np.zeros((10, 10))
    for doc, shard, slot in out:
        table[doc // 240, int((shard * 100 + slot) // 240)] += 1
    assert ((table - 24) ** 2 / 24).sum() < 150  # 81 degrees of freedom


def test_large_populations():
    """The draw for large populations agrees with numpy's in mean and spread, and keeps sums."""
    rng = np.random.default_rng(2)
    big = [sharding.hypergeometric(rng, 3_000_000_000, 7_000_000_000, 1_000_000) for _ in range(300)]
    assert abs(np.mean(big) - 300_000) < 100 and 350 < np.std(big) < 570
    places = np.full(1000, 50_000_000)
    got = sharding.draw(rng, places, 20_000_000_000)
    assert got.sum() == 20_000_000_000 and (got >= 0).all() and (got <= places).all()


def test_small_populations_by_the_same_formula(monkeypatch):
    monkeypatch.setattr(sharding, "SMALL", 0)
    rng = np.random.default_rng(6)
    got = Counter(sharding.hypergeometric(rng, 4, 6, 5) for _ in range(20_000))
    want = [math.comb(4, k) * math.comb(6, 5 - k) / math.comb(10, 5) * 20_000 for k in range(5)]
    assert all(abs(got[k] - want[k]) < 5 * want[k] ** 0.5 for k in range(5)) and set(got) <= set(range(5))


def test_shards_take_odd_tables(spark, tmp_path):
    docs = odd_documents(spark)
    rows = sharding.shuffled_shards(docs)
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.where("doc_id IS NOT NULL").collect())
    assert sorted((r["doc_id"], r["text"]) for r in rows.collect()) == texts
    assert placed(docs, shards=3) == placed(docs, shards=3)
    assert placed(no_documents(spark)) == []
    sharding.write_shards(rows, str(tmp_path / "shards"))
    again = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["text"]) for r in again.collect()) == texts
    got = {r["doc_id"]: r for r in sharding.shard_digests(docs).collect()}
    assert got[6]["size"] == len(LONG) + 8 and got[8]["text_crc32"] == zlib.crc32(b"x") and got[10]["size"] == len(texts_by_id(docs)[10].encode()) + 8
    assert got[0]["size"] == 8 and got[0]["text_crc32"] == 0 and got[0]["law"] == "rows" and got[0]["grown_shard"] is None
    with pytest.raises(ValueError):
        sharding.shuffled_shards(docs, shards=0)
