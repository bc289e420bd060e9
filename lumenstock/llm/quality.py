"""Document quality by positive-unlabelled learning.

Trusted positives are documents labelled 1, everything else is unlabelled web text; labels 0 are not used. The class
prior is estimated over all documents: the least ratio, over score thresholds, of the share of documents above the
threshold to the positives' share (with a deviation term). Such a ratio bounds the prior from above whatever the
classifier, so of several penalties on the weights the one with the least bound is taken. Documents fall into two halves by a hash; a first classifier
of each half scores the other one, so no score comes from a model that saw the row. The classifier then minimises the non-negative unbiased risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])
by gradient steps; where the second part turns negative, the step goes up in it instead of down.

Features are of the whole text and know no language: rates of byte classes and of their pairs, word repetition,
line repetition, lengths; each cut into bins at quantiles over all documents, so the score is a sum of one weight for
each feature. Quantiles and prior come from counts on fixed grids, summed per task and then in Spark. The rows of the
gradient steps are bounded (`positives`, `unlabelled`, spread by a hash of the id over the table); scores cover all rows.

Null and empty texts have the features of an empty text. Rows without an id are left out; rows that repeat an id
are scored each. Without a positive label every score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, labelled_sample, small

BINS = 10
GRID = 1 << 14  # cells of a feature: the upper bits of a float, 1.6 percent apart
N_FEATURES = 118
RIDGES = (1.0, 10.0, 100.0)
SCORES = 1 << 12  # cells of a score, its logit from -30 to 30
_CLASS = np.full(256, 8, np.uint8)
for _c, _members in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:'\"-()", b"!?", b"|"]):
    _CLASS[list(_members)] = _c
_CLASS[128:] = 9


@dataclass
class Model:
    prior: float
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    bias: float


def features(texts: list[str]) -> np.ndarray:
    """One row of numbers for each text."""
    out = []
    for at in range(0, len(texts), 64):
        some = texts[at:at + 64]
        data = [t.encode("utf-8", "replace") for t in some]
        sizes = np.array([len(d) for d in data])
        pairs = np.zeros((len(some), 100))
        for i, d in enumerate(data):
            kinds = _CLASS[np.frombuffer(d, np.uint8)]
            if len(kinds) > 1:
                pairs[i] = np.bincount(kinds[:-1] * 10 + kinds[1:], minlength=100)
        rates = pairs.reshape(-1, 10, 10).sum(2) / np.maximum(sizes - 1, 1)[:, None]
        more = []
        for t, size in zip(some, sizes):
            words, lines = t.split(), t.split("\n")
            counts = Counter(words)
            n = max(len(words), 1)
            more.append((np.log1p(size), np.log1p(len(words)), len(counts) / n, max(counts.values(), default=0) / n, size / n, len(set(lines)) / len(lines), np.log1p(len(lines)), len(counts) / n ** 0.5))
        out.append(np.hstack([np.sqrt(pairs / np.maximum(sizes - 1, 1)[:, None]), rates, np.array(more)]))
    return np.vstack(out) if out else np.zeros((0, N_FEATURES))


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Flat place of the bin of each feature."""
    place = np.empty(x.shape, np.int32)
    for j in range(x.shape[1]):
        place[:, j] = np.searchsorted(edges[j], x[:, j], "right") + j * BINS
    return place


def _one_hot(place: np.ndarray) -> np.ndarray:
    out = np.zeros((len(place), place.shape[1] * BINS), np.float32)
    out[np.arange(len(place))[:, None], place] = 1
    return out


def minimise(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, ridge: float = RIDGES[0]) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk for the logistic loss (Adam, full gradients).

    `ridge` is that of one positive: the risk is a mean, so the penalty falls with their number.
    """
    ridge = ridge / len(p)
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    mean = lambda x, g: np.append(x.T @ g.astype(np.float32), g.sum()) / len(g)
    for t in range(1, steps + 1):
        fp, fu = p @ w[:-1].astype(np.float32) + w[-1], u @ w[:-1].astype(np.float32) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        rest = mean(u, su) - prior * mean(p, sp)
        grad = prior * mean(p, sp - 1) + (rest if negative >= 0 else -rest)
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the logits of both (larger: more positive)."""
    return prior_of_counts(*(np.bincount(_score_cells(s), minlength=SCORES) for s in (positive, unlabelled)))[1]


def _score_cells(logits: np.ndarray) -> np.ndarray:
    return np.clip((logits + 30) * (SCORES / 60), 0, SCORES - 1).astype(np.int64)


def prior_of_counts(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float]:
    """The least bound (with its deviation) and the share there, from the counts of both by score cell."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = (c[::-1].cumsum()[::-1] / n for c, n in ((positive, n_p), (unlabelled, n_u)))
    cuts = np.flatnonzero((positive > 0) & (above_p >= 0.1))
    a, b = above_u[cuts], above_p[cuts]
    # The deviation of the ratio, from the variances of both shares; they are least near 1, where few rows are cut off.
    slack = np.sqrt(2 * np.log(20) * (a * (1 - a) / n_u + (a / b) ** 2 * b * (1 - b) / n_p)) / b
    at = np.argmin(a / b + slack)
    return float(a[at] / b[at] + slack[at]), float(np.clip(a[at] / b[at], 0.02, 0.98))


def _half(doc_id):
    """One of two halves of the documents, for models that score what they did not see."""
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)).cast("int")


def _summed(docs: DataFrame, cells, size: int) -> dict[int, int]:
    """How often each of `size` cells occurs over all documents: `cells` gives those of a batch; tasks add theirs up."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in small(batches):
            total += np.bincount(cells(batch.column(1).to_pylist(), batch.column(2).to_numpy()), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    rows = documents(docs).select("doc_id", "text", _half(F.col("doc_id")).alias("half"))
    return dict(map(tuple, rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()))  # at most `size`


def _grid(x: np.ndarray) -> np.ndarray:
    """Flat cell of each feature (all are 0 or more)."""
    return (x.astype("<f4").view(np.uint32) >> 17).astype(np.int64) + np.arange(x.shape[1]) * GRID


def bin_edges(docs: DataFrame) -> np.ndarray | None:
    """Quantiles of each feature over all documents, at cell bounds: features x (BINS - 1); None of an empty table."""
    counted = _summed(docs, lambda texts, half: _grid(features(texts)).ravel(), N_FEATURES * GRID)
    if not counted:
        return None
    edges = np.zeros((N_FEATURES, BINS - 1))
    cells = np.array(sorted(counted))
    for j in range(N_FEATURES):
        own = cells[(cells >= j * GRID) & (cells < (j + 1) * GRID)]
        n = np.cumsum([counted[int(c)] for c in own])
        at = own[np.searchsorted(n, n[-1] * np.arange(1, BINS) / BINS)] - j * GRID
        edges[j] = (at.astype(np.uint32) << 17).astype(np.uint32).view(np.float32)
    return edges


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> Model | None:
    """Learn from at most so many positives (outside the held-out fold) and unlabelled documents, with the bins and the
    class prior of all documents; None without positives."""
    good = labelled_sample(docs, labels.where("quality = 1"), "quality", positives).select(F.lit(True).alias("good"), "text", "doc_id", _half(F.col("doc_id")).alias("half"))
    chosen = documents(docs).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(unlabelled)
    web = documents(docs).join(F.broadcast(chosen), "doc_id").select(F.lit(False).alias("good"), "text", "doc_id", _half(F.col("doc_id")).alias("half"))  # at most `unlabelled` ids

    def measure(batches):
        import pyarrow as pa

        for batch in small(batches):
            x = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in x], pa.binary())], names=["good", "doc_id", "half", "x"])

    rows = sorted(good.unionByName(web).mapInArrow(measure, "good boolean, doc_id long, half int, x binary").collect())
    x = {g: np.array([np.frombuffer(r.x) for r in rows if r.good is g]) for g in (True, False)}
    if not len(x[True]) or not len(x[False]):
        return None
    edges = bin_edges(docs)
    places = {g: _binned(x[g], edges) for g in (True, False)}
    p, u = (_one_hot(places[g]) for g in (True, False))
    half = {g: np.array([r.half for r in rows if r.good is g]) for g in (True, False)}
    weights, bias = np.zeros((2, len(RIDGES), p.shape[1])), np.zeros((2, len(RIDGES)))
    for h in (0, 1):  # the model of the other half; of all rows where that one is empty
        others = [a[half[g] != h] for g, a in ((True, p), (False, u))]
        for i, ridge in enumerate(RIDGES):
            weights[h, i], bias[h, i] = minimise(*(others if all(map(len, others)) else (p, u)), 0.5, ridge=ridge)

    def cells(place, halves):
        """Score cells by the models of the other half, one range of cells for each penalty."""
        return np.concatenate([i * SCORES + _score_cells(weights[halves[:, None], i, place].sum(1) + bias[halves, i]) for i in range(len(RIDGES))])

    size = len(RIDGES) * SCORES
    known = np.bincount(cells(places[True], half[True]), minlength=size).reshape(-1, SCORES)
    counted = _summed(docs, lambda texts, halves: cells(_binned(features(texts), edges), halves), size)
    everything = np.array([counted.get(c, 0) for c in range(size)]).reshape(-1, SCORES)
    _, prior = min(prior_of_counts(k, e) for k, e in zip(known, everything))
    w, b = minimise(p, u, prior)
    return Model(prior, edges, w, b)


def _scores(texts: list[str], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.weights[_binned(features(texts), model.edges)].sum(1) + model.bias, -30, 30)))


def good_rows(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """Rows of `docs` predicted good, all columns as they are; all rows where no label says what is good."""
    if model is None:
        return docs

    def run(batches):
        import pyarrow as pa

        for batch in small(batches):
            yield batch.filter(pa.array(_scores([t or "" for t in batch.column("text").to_pylist()], model) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    def run(batches):
        import pyarrow as pa

        for batch in small(batches):
            texts = batch.column(2).to_pylist()
            s = np.zeros(len(texts)) if model is None else _scores(texts, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, threshold: float = 0.5) -> DataFrame:
    return score(docs, fit(docs, labels, positives, unlabelled), threshold)
