"""Exact and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lumenstock.llm import exact_dedup, ngram_join
from lumenstock.llm.common import connected_components
from lumenstock.llm.metric_join import near_vectors

from .support import Groups, no_documents, odd_documents


def test_directory_doubles_and_covers_all_keys():
    rng = random.Random(1)
    sizes = {rng.randrange(256): rng.randrange(1, 50) for _ in range(120)} | {200: 5000}
    depth, buckets = exact_dedup.directory(sizes, 8, 300)
    assert depth == 8  # one prefix holds more than a bucket may
    spans = [(p << (8 - d), (p + 1) << (8 - d)) for p, d in buckets]
    assert spans[0][0] == 0 and spans[-1][1] == 256 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for (low, high), (_, d) in zip(spans, buckets):
        assert d == 8 or sum(n for k, n in sizes.items() if low <= k < high) <= 300
    assert exact_dedup.directory({}, 8, 300) == (0, [(0, 0)])


def test_chains_compare_bytes():
    import pyarrow as pa

    rows = [(0, 5, "a", b"1", 1, 1), (0, 5, "b", b"2", 9, 2), (0, 5, "a", b"1", 7, 1), (0, 6, "a", b"1", 3, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", "key", "text", "sha", "keep_id", "n"])
    out = [tuple(r.values()) for b in exact_dedup._chain([batch]) for r in b.to_pylist()]
    assert out == [(0, 5, 0, "a", b"1", 7, 2), (0, 5, 1, "b", b"2", 9, 2), (0, 6, 0, "a", b"1", 3, 1)]


@pytest.mark.parametrize("options", [{}, {"capacity": 100, "max_depth": 6, "fold_bytes": 10}])
def test_exact_duplicates(spark, options):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None]
    want = sorted((d, k := max(i for i, x in rows if x == t), sum(x == t for _, x in rows), d == k, hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs, **options).collect())) == want
    assert exact_dedup.exact_duplicates(no_documents(spark), **options).count() == 0


def test_one_row_of_equal_texts_stays(spark):
    """Also where rows repeat an id and its text, or an id with another text."""
    rows = [(1, "x"), (1, "x"), (1, "y"), (0, "x"), (0, "y"), (2, "y"), (2, "y"), (2, "y"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    stay = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert sorted(stay) == sorted((hashlib.sha256(t.encode()).hexdigest(), i) for t, i in [("x", 1), ("y", 2), ("", 3)])
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 3), (2, 5), (3, 2)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7)]
    groups = Groups()
    for a, b in edges:
        groups.union(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: groups.find(x) for a, b in edges for x in (a, b) if a != b}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    groups, ids = Groups(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                groups.union(a, b)
    return sorted((d, len(s), groups.find(d)) for d, s in sets.items())


@pytest.mark.parametrize("options", [{}, {"short": 2, "hubs": 1, "tries": 1, "width": 16}, {"words": 5, "percent": 80, "short": 3}])
def test_ngram_join_equals_brute_force(spark, options):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    shared = " ".join(base[:60])
    for i in range(150):
        text = list(base) if i % 3 == 0 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(6)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, (" ".join(text) + (" " + shared if i % 7 == 0 else "")).title()))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40, 4)] + [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  B"), (2004, "b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, ngram_join.links_and_components(docs, **options).collect()))
    assert got == _brute(rows, options.get("words", 4), options.get("percent", 85))


def test_ngram_join_block_returns_a_forest():
    """A large group of near copies gives fewer links than documents, and only in the list of its least common shingle."""
    import pyarrow as pa

    group = [np.array(sorted([*range(2, 40), 100 + i]), np.uint64) for i in range(60)]
    loose = [np.array([2, 3, *range(1000 * i, 1000 * i + 40)], np.uint64) for i in range(1, 6)]
    sets = group + [np.unique(x) for x in loose]

    def found(token):
        return ngram_join._across(80)(pa.table({
            "token": [token] * len(sets), "i": [0] * len(sets), "j": [0] * len(sets), "side": [0] * len(sets), "rep": list(range(len(sets))),
            "n": [len(x) for x in sets], "c": list(range(len(sets))), "tokens": [x[:9].tolist() for x in sets], "longs": [[2, 3]] * len(sets),
            "shingles": [x.tobytes() for x in sets]})).to_pylist()

    groups = Groups()
    links = found(2)
    for link in links:
        groups.union(link["a"], link["b"])
    assert len(links) == 59 and {groups.find(i) for i in range(60)} == {0}
    assert [groups.find(i) for i in range(60, 65)] == list(range(60, 65))
    assert found(3) == []


def test_ngram_join_takes_one_text_of_a_repeated_id(spark):
    """The longest, then the last in byte order; the other texts of the id link nothing."""
    first, last = "a b c d e f g", "h i j k l m n"
    rows = [(1, first), (1, last), (2, first), (3, last), (4, "short"), (4, first + " o"), (4, None), (5, first + " o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.links_and_components(docs).collect()
    assert sorted(map(tuple, got)) == [(1, 4, 1), (1, 4, 1), (2, 4, 2), (3, 4, 1), (4, 5, 4), (4, 5, 4), (4, 5, 4), (5, 5, 4)]


def test_ngram_join_takes_odd_tables(spark):
    docs = odd_documents(spark)
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    got = ngram_join.links_and_components(docs).distinct().collect()
    assert sorted(map(tuple, got)) == _brute(rows.items(), 4, 85)
    assert ngram_join.links_and_components(no_documents(spark)).count() == 0


@pytest.mark.parametrize("options", [{}, {"per_cell": 20, "block": 16}])
def test_metric_join_equals_brute_force(spark, options):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    x = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=8) * (0.25 if i % 2 else 0.6)]) for i in range(300)]
    x += [(500 + i, list(x[3][1])) for i in range(40)] + [(600, [v * 7 for v in x[3][1]]), (601, [1.0, 0.0]), (602, [1.0, 0.001])]
    bad = [(700, None), (701, []), (702, [0.0] * 8), (703, [None] + [1.0] * 7), (704, [float("nan")] * 8), (705, [float("inf")] * 8)]
    rows = x + bad + [(None, x[0][1])]
    vectors = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id long, embedding array<double>, label int, rep double")
    groups, n = Groups(), dict.fromkeys((i for i, _ in x + bad), 0)
    for i, a in x:
        for j, b in x:
            if i < j and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                groups.union(i, j)
                n[i] += 1
                n[j] += 1
    want = sorted((i, c, groups.find(i), groups.find(i) == i) for i, c in n.items())
    assert sorted(map(tuple, near_vectors(vectors, **options).collect())) == want
    assert near_vectors(vectors.where("false"), **options).count() == 0


def test_vectors_that_share_an_id(spark):
    """Rows that repeat an id are vectors of their own; a component has its smallest id as name."""
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0]), (8, [0.0, 1.0]), (9, [-1.0, 0.0]), (9, None), (3, [0.02, 1.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    want = [(5, 1, 5, True), (5, 3, 3, False), (6, 1, 5, False), (7, 3, 3, False), (8, 3, 3, False), (9, 0, 9, True), (9, 0, 9, True), (3, 3, 3, True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_vectors_at_the_threshold(spark):
    """Cosines just above, at and below 0.9 in double precision."""
    rows = [(1, [1.0, 0.0]), (2, [0.9, (1 - 0.81) ** 0.5]), (3, [0.8999999, (1 - 0.8999999 ** 2) ** 0.5 * -1])]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    assert got[3] == 0 and got[1] == got[2] == int(cosine(rows[0][1], rows[1][1]) >= 0.9)


def test_pivots_of_one_direction(spark):
    """Scaled copies, and copies one rounding apart, are distinct rows of one direction; none of their links may be lost."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=12)
    copies = [base * f for f in rng.uniform(0.1, 9, 200)] + [np.nextafter(base, rng.choice([-9.0, 9.0], 12)) for _ in range(200)]
    rows = [(i, list(map(float, v))) for i, v in enumerate(copies + list(base + rng.normal(size=(200, 12)) * 0.3))]
    units = np.array([np.array(v) / np.linalg.norm(v) for _, v in rows])
    links = units @ units.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_cell=4, block=64).collect()}
    assert [got[i].n_links for i, _ in rows] == links.sum(1).tolist()
    assert {got[i].component_id for i in range(400)} == {0}
