"""Classifiers on held-out rows, and the parts they are made of."""

import itertools
import math
import random
import zlib

import numpy as np

from lumenstock.llm import quality, toxicity

from .support import labels, no_documents, odd_documents

SLURS = ["grobnik", "vexmor", "drabble"]


def _corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 150))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            at = rng.randrange(len(text) + 1)
            text[at:at] = [rng.choice(SLURS) + rng.choice(["", "s", "ly"]) for _ in range(3)]
        body = " | ".join(w + "%%" for w in text) if junk else " ".join(text) + "."
        rows.append((i, body))
        marks.append((i, int(not junk), int(toxic)))
    return rows, marks


def _held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_segments_are_the_maximal_ones():
    """Against the definition: best segment first, then the best on either side of it."""
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-toxicity.DRIFT, -toxicity.DRIFT, rng.randrange(1, 9) / 4]) for _ in range(rng.randrange(1, 14))]

        def split(low, high):
            best = max(((sum(s[a:b]), -(b - a), -a) for a, b in itertools.combinations(range(low, high + 1), 2)), default=(0, 0, 0))
            if best[0] <= 1e-9:
                return []
            a, b = -best[2], -best[2] - best[1]
            return split(low, a) + [(a, b - 1, best[0])] + split(b, high)

        got = toxicity.segments([(i, x) for i, x in enumerate(s) if x > 0])
        assert [round(x[2], 6) for x in sorted(got)] == [round(x[2], 6) for x in split(0, len(s))]


def test_segments_over_any_scores():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(-20, 13) / 4 for _ in range(rng.randrange(1, 14))]

        def split(low, high):
            best = max(((sum(s[a:b]), -(b - a), -a) for a, b in itertools.combinations(range(low, high + 1), 2)), default=(0, 0, 0))
            if best[0] <= 1e-9:
                return []
            a, b = -best[2], -best[2] - best[1]
            return split(low, a) + [(a, b - 1, best[0])] + split(b, high)

        assert [round(x[2], 6) for x in sorted(toxicity.segments(list(enumerate(s))))] == [round(x[2], 6) for x in split(0, len(s))]


def test_every_word_has_its_own_score(spark):
    """Mild words are not pushed down to the drift, clean words go below it, and a clean parent pulls its stems down."""
    own = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03}")  # noqa: E731  a word of each text
    rows = [(i, f"{own(i)} slur mild mild grobnest filler" if i % 2 == 0 else f"{own(i)} grobster mild filler" + " calm grobster" * 4) for i in range(400)]
    marks = [(i, 1, int(i % 2 == 0)) for i, _ in rows]
    words = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)).words
    assert -toxicity.DRIFT < words["mild"] < 0 and words["slur"] > 0
    assert words["calm"] < -2 * toxicity.DRIFT
    assert words["grobonly"] < -toxicity.DRIFT  # by its clean first letters
    found = toxicity.scan("slur calm slur", words)[1]
    assert [x[:2] for x in found] == [(0, 0), (2, 2)]


def test_decay_solves_its_equation():
    scores = np.array([1.0, 2.5, 0.5])
    x = toxicity._decay(scores, 1000)
    assert math.isclose((np.exp(x * scores).sum() + 997 * math.exp(-x * toxicity.DRIFT)) / 1000, 1, rel_tol=1e-6)


def test_toxicity_on_held_out_rows(spark):
    rows, marks = _corpus(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels(spark, marks)).collect()}
    assert all(got[i].held_out == _held(i) for i, _ in rows)
    wrong = [i for i, _, t in marks if _held(i) and got[i].predicted != t]
    assert len(wrong) <= 0.02 * sum(_held(i) for i, _ in rows)
    assert all(got[i].predicted == int(got[i].score >= 0.7) and 0 <= got[i].score <= 1 for i, _ in rows)
    words = dict(rows)[5 * 19].lower()
    p = got[5 * 19].passages[0]
    assert any(s in " ".join(toxicity.WORDS.findall(words)[p.first_word:p.last_word + 1]) for s in SLURS)


def test_held_out_labels_change_nothing(spark):
    rows, marks = _corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    other = [(i, 1 - q, 1 - t) if _held(i) else (i, q, t) for i, q, t in marks]
    for f in (toxicity.toxicity, quality.quality):
        a, b = ({r.doc_id: r.score for r in f(docs, labels(spark, m)).collect()} for m in (marks, other))
        assert all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_quality_on_held_out_rows(spark):
    rows, marks = _corpus(900)
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)).collect()}
    wrong = [i for i, q, _ in marks if _held(i) and got[i].predicted != q]
    assert len(wrong) <= 0.03 * sum(_held(i) for i, _ in rows)


def test_prior_estimate():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 5600), rng.normal(-2, 1, 2400)])
    assert abs(quality.estimate_prior(positive, mixed) - 0.7) < 0.06


def test_bins_are_quantiles_over_all_documents(spark):
    rows, _ = _corpus(700)
    x = quality.features([t for _, t in sorted(rows)])
    edges = quality.bin_edges(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    want = np.quantile(x, np.arange(1, quality.BINS) / quality.BINS, axis=0, method="inverted_cdf").T
    assert edges.shape == (118, quality.BINS - 1) and (edges <= want + 1e-6).all() and (want <= edges * (1 + 1 / 64) + 1e-6).all()
    assert quality.bin_edges(no_documents(spark)) is None


def test_prior_of_few_positives(spark):
    """The bad ones are found although few rows are labelled."""
    rows, marks = _corpus(300)
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks))
    share = sum(q for _, q, _ in marks) / len(marks)
    assert abs(model.prior - share) < 0.12


def test_features_of_odd_texts():
    x = quality.features(["", " ", "\n\n", "a" * 100_000, "é|!?"])
    assert x.shape == (5, 118) and np.isfinite(x).all()


def test_scores_take_odd_tables(spark):
    docs, none = odd_documents(spark), no_documents(spark)
    marks = [(0, 1, 0), (3, 1, 1), (4, None, None), (6, 0, 0), (None, 1, 1), (3, 1, 1), (99, 1, 1), (8, 1, 0)]
    for f in (toxicity.toxicity, quality.quality):
        for m in (marks, []):
            got = f(docs, labels(spark, m)).collect()
            assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
            assert all(0 <= r.score <= 1 for r in got)
        assert f(none, labels(spark, marks)).count() == 0
