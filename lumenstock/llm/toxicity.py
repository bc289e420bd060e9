"""Toxic passages by maximum-scoring segments over token log-odds.

A word's score is its log-odds between toxic and clean labelled documents under Dirichlet priors: the prior of a word
is its first six letters, theirs the first five, then the first four, then the classes' sizes; so inflected and
compounded forms share evidence, and a word without any scores 0. From it goes a drift that makes ordinary text score
negative. A linear scan over the scores of all words finds every maximal-scoring segment of a document. Scores of segments follow an extreme-value law: lambda solves
sum(p * exp(lambda * s)) = 1 over the scores of clean text, K is fitted to the maxima of clean documents, and a
segment of score S in a document of N words has the expected count E = K * N * exp(-lambda * S). A document's
evidence is the sum of -ln E over its significant segments, mapped to a probability by a logistic curve.

Word scores used for the calibration come from the other half of the sample, so that no document helps to score
itself. The labelled sample is bounded (`limit`, spread by a hash of the id); everything else covers all rows.

Null and empty texts have no words: evidence 0. Rows without an id are left out; rows that repeat an id are scored
each. Without a toxic label every score is 0.
"""

from __future__ import annotations

import copy
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, labelled_sample, small, stored

WORDS = re.compile(r"[^\W\d_]+")
PRIOR, DRIFT, STEMS = 5.0, 1.5, (4, 5, 6)
RESULT = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first_word:int,last_word:int,score:double,expected:double>>"


class Counts:
    """(toxic, clean) by stem in flat arrays, about a tenth of a dictionary: stems by hash, compared byte by byte."""

    def __init__(self, names: list[str]):
        keys = [n.encode("utf-8", "surrogatepass") for n in names]
        self.mask = (1 << max(len(keys), 1).bit_length()) - 1
        hashes = np.array([zlib.crc32(k) & self.mask for k in keys], np.int64)
        self.order = np.argsort(hashes, kind="stable")
        self.starts = np.searchsorted(hashes[self.order], np.arange(self.mask + 2)).astype(np.int32)
        keys = [keys[i] for i in self.order]
        self.names = b"".join(keys)
        self.ends = np.concatenate([[0], np.cumsum([len(k) for k in keys], dtype=np.int64)]).astype(np.int64)

    def of(self, toxic: np.ndarray, clean: np.ndarray) -> Counts:
        """The same stems with counts in the order of the names given."""
        out = copy.copy(self)
        out.toxic, out.clean = toxic[self.order], clean[self.order]
        return out

    def get(self, stem: str) -> tuple[int, int]:
        key = stem.encode("utf-8", "surrogatepass")
        at = zlib.crc32(key) & self.mask
        for i in range(self.starts[at], self.starts[at + 1]):
            if self.names[self.ends[i]:self.ends[i + 1]] == key:
                return int(self.toxic[i]), int(self.clean[i])
        return 0, 0


class Words(dict):
    """Score of every word, kept as words come up. The whole word ends in "$" among the stems of `counts`."""

    def __init__(self, counts: Counts, share: float):
        super().__init__()
        self.counts, self.share = counts, share

    def __reduce__(self):
        return Words, (self.counts, self.share)

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        p = self.share
        for stem in stems(word):
            toxic, clean = self.counts.get(stem)
            p = (toxic + PRIOR * p) / (toxic + clean + PRIOR)
        self[word] = s = math.log(p / (1 - p)) - math.log(self.share / (1 - self.share)) - DRIFT
        return s


def stems(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) > n] + [word + "$"]


@dataclass
class Model:
    words: Words | None
    decay: float = 1.0
    k: float = 1.0
    intercept: float = -40.0
    slope: float = 0.0


def segments(places: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, as (first, last, score); `places` are words of any score by place.

    Words between the places score -DRIFT each. Every candidate keeps the running total before and after it and the
    nearest earlier candidate that starts lower; a new one joins back to that one if it ends higher.
    """
    held: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, nearest that starts lower
    gain = 0.0
    for i, (place, score) in enumerate(places):
        if score <= 0:
            gain += score
            continue
        before = gain - DRIFT * (place - i)
        gain += score
        new = (place, place, before, before + score)
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                held.append((*new, j))
                break
            new, lower = (held[j][0], new[1], held[j][2], new[3]), held[j][4]
            del held[j:]
            j = lower
    return [(a, b, high - low) for a, b, low, high, _ in held]


def scan(text: str, words: Words) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and the segments."""
    found = WORDS.findall(text.lower())
    return len(found), segments(list(enumerate(map(words.__getitem__, found))))


def significant(n: int, found: list, model: Model) -> list[tuple[int, int, float, float]]:
    """Segments expected less than once in a clean document of this length, with that expected count."""
    out = [(a, b, s, model.k * n * math.exp(-model.decay * s)) for a, b, s in found]
    return [x for x in out if x[3] < 1]


def evidence(passages: list) -> float:
    return sum(min(50.0, -math.log(max(x[3], 1e-300))) for x in passages)


def _decay(scores: np.ndarray, n_words: int, times: np.ndarray | None = None) -> float:
    """The positive root of sum(p * exp(x * s)) = 1; `scores`, each so many `times`, are of `n_words` clean words, of which the others score -DRIFT."""
    times = np.ones(len(scores)) if times is None else times
    if not (scores > 0).any():
        return math.log(max(n_words, 2)) / DRIFT
    rest = max(n_words - times.sum(), 0)
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        value = (times @ np.exp(np.minimum(mid * scores, 600)) + rest * math.exp(-mid * DRIFT)) / (rest + times.sum())
        low, high = (low, mid) if value > 1 else (mid, high)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) by Newton's method with a small ridge."""
    a, b = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        grad = design.T @ (p - y) + np.array([0, 0.05 * b])
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.05])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
    return float(a), float(max(b, 0.0))


def fit(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> Model:
    """Word scores and calibration from at most `limit` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", limit)
    sample = sample.groupBy("text").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))  # one vote a text
    sample = sample.select("label", "text", (F.xxhash64("doc_id") % 2 == 0).alias("half"))

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        held: dict = {}
        for batch in small(batches):
            for label, text, half in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((label, half), Counter()).update(WORDS.findall(text.lower()))
        rows = [(w, label, half, n) for (label, half), c in held.items() for w, n in c.items()]
        types = [pa.string(), pa.int32(), pa.bool_(), pa.int64()]
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 20_000]), types)], names=["word", "label", "half", "n"])

    kinds = [("t0", 1, False), ("c0", 0, False), ("t1", 1, True), ("c1", 0, True)]
    sums = lambda: [F.coalesce(F.sum(F.when((F.col("label") == v) & (F.col("half") == h), F.col("n"))), F.lit(0)).alias(k) for k, v, h in kinds]
    words = stored(sample.mapInArrow(count, "word string, label int, half boolean, n long").groupBy("word").agg(*sums()), "toxic-words")
    totals = words.agg(*[F.coalesce(F.sum(k), F.lit(0)) for k, *_ in kinds]).first()
    share = (totals[0] + totals[2]) / max(sum(totals), 1)
    if not 0 < share < 1:
        return Model(None)
    stem = [F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS] + [F.concat("word", F.lit("$"))]
    counted = words.select(F.explode(F.array(*stem)).alias("stem"), *[k for k, *_ in kinds]).where("stem IS NOT NULL")
    counted = counted.groupBy("stem").agg(*[F.sum(k).alias(k) for k, *_ in kinds])
    known = counted.toArrow()  # every stem of the sample; grows with `limit` only
    t0, c0, t1, c1 = (known.column(k).to_numpy() for k, *_ in kinds)
    counts = Counts(known.column("stem").to_pylist())
    del known
    model = Model(Words(counts.of(t0 + t1, c0 + c1), share))
    halves = {False: Words(counts.of(t1, c1), share), True: Words(counts.of(t0, c0), share)}

    def clean_scores(batches):
        import pyarrow as pa

        for batch in batches:
            names, *of = (c.to_pylist() for c in batch.columns)
            rows = [(halves[h][w], n) for h, column in zip((False, True), of) for w, n in zip(names, column) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], names=["s", "n"])

    def trial(batches):
        import pyarrow as pa

        for batch in small(batches):
            rows = []
            for label, text, half in zip(*(c.to_pylist() for c in batch.columns)):
                words = halves[half]
                found = WORDS.findall(text.lower())
                rows.append((label, len(found), [s for *_, s in segments(list(enumerate(map(words.__getitem__, found))))]))
            types = [pa.int32(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["label", "n", "found"])

    tried = sample.mapInArrow(trial, "label int, n long, found array<double>").collect()  # at most `limit` rows of segments
    clean = [r for r in tried if r.label == 0]
    spectrum = words.select("word", "c0", "c1").mapInArrow(clean_scores, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    model.decay = _decay(spectrum.column("s").to_numpy(), sum(r.n for r in clean), spectrum.column("n").to_numpy().astype(float))
    spread = sum(r.n * math.exp(-model.decay * max(r.found, default=0.0)) for r in clean)
    model.k = len(clean) / spread if spread else 1.0
    x = np.array([evidence(significant(r.n, [(0, 0, s) for s in r.found], model)) for r in tried])
    model.intercept, model.slope = _logistic(x, np.array([r.label for r in tried], float))
    return model


def _judge(model: Model):
    """Score and significant passages of a text."""
    def of(text: str) -> tuple[float, list]:
        if model.words is None:
            return 0.0, []
        found = significant(*scan(text, model.words), model)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * evidence(found))))), found

    return of


def clean_rows(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows of `docs` not predicted toxic, all columns as they are. A decision reads the row's own text only, so nothing is shuffled."""
    def run(batches):
        import pyarrow as pa

        judge = _judge(model)
        for batch in small(batches):
            yield batch.filter(pa.array([judge(t or "")[0] < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages by word place with their expected counts."""
    def run(batches):
        import pyarrow as pa

        place = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        judge = _judge(model)
        for batch in small(batches):
            scores, passages = [], []
            for text in batch.column(2).to_pylist():
                value, found = judge(text)
                scores.append(value)
                passages.append([dict(zip(("first_word", "last_word", "score", "expected"), x)) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(passages, place)], names=["doc_id", "held_out", "score", "predicted", "passages"])

    return documents(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, RESULT)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = 20_000, threshold: float = 0.7) -> DataFrame:
    return score(docs, fit(docs, labels, limit), threshold)
