"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; the unlabelled set is plain web text whose labels are not looked at.  A small
network minimises the non-negative unbiased risk: with class prior p, the loss of calling unlabelled rows bad, less p
times that of calling positives bad, is kept from falling below zero (when it does, the step goes the other way).
The class prior is estimated from positives and unlabelled rows alone, labels of 0 are not needed and not read (class_prior).

What it learns from is bounded: at most MAX_POSITIVE trusted rows and MAX_UNLABELLED others, those with the smallest
hash of their id.  Scores are computed for every row from its whole text.

Defined results: a null text counts as empty and gets the score of the empty text; equal texts get equal scores; without
any training row labelled 1 every score is 0.5 (predicted 1); with fewer than MIN_FOLD rows in a fold the prior is 0.5; repeated rows are scored each, and of rows that share an id one
is learned from; rows with a null id are scored and not learned from; very long texts are read whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import give_back, short, unused

MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 80, 512, 3e-3, 7
#: Epochs of the networks that only order rows for the prior, the least number of rows of a fold, and the confidence of its bound.
PRIOR_EPOCHS, MIN_FOLD, PRIOR_DELTA = 20, 5, 0.1

_LETTER, _UPPER, _DIGIT, _SPACE, _WIDE = (np.zeros(256, bool) for _ in range(5))
_LETTER[[*range(65, 91), *range(97, 123)]] = _UPPER[65:91] = _DIGIT[48:58] = _SPACE[[9, 10, 11, 12, 13, 32]] = _WIDE[128:] = True
_MARKS = np.array([i for i in range(33, 127) if not (_LETTER | _DIGIT)[i]])


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes and of each ASCII mark, and how words and lines repeat; nothing but the text goes in."""
    data = (text or "").encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    # A word that ends in a mark tells more than the mark's share alone: runs of marks, shouting, tables.
    ends = np.bincount(np.frombuffer(bytes([x[-1] for x in words]), np.uint8), minlength=256) if words else np.zeros(256)
    alone = sum(1 for x in words if len(x) == 1 and not x.isalnum())
    again = sum(map(bytes.__eq__, words, words[1:]))
    caps = sum(1 for x in words if len(x) > 2 and x.isupper())
    return np.concatenate(
        [
            [np.log1p(len(data)), np.log1p(len(lines)), len(words) / n * 5, sizes.mean() / 10, sizes.std() / 10, min(sizes.max(), 200) / 50],
            [count[m].sum() / n for m in (_LETTER, _UPPER, _DIGIT, _SPACE, _WIDE)],
            [count[_MARKS].sum() / n, count[10] / n * 20, len(set(words)) / w, len(set(lines)) / max(1, len(lines)), alone / w, caps / w, again / w, count[:9].sum() / n],
            np.sqrt(count[_MARKS] / n),
            np.sqrt(ends[_MARKS] / w),
        ]
    )


class PUModel:
    """Two-layer network over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def risk_gradient(z: np.ndarray, n: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of some logits (n of positives, then those of unlabelled rows), and the step's gradient.

    With the logistic loss, calling a row bad costs softplus(z) and calling it good softplus(-z).  The negative part, mean
    over unlabelled less prior times mean over positives, counts as zero where it falls below, and is then stepped back up.
    """
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    bad = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
    good = prior * np.logaddexp(0, -z[:n]).mean()
    g = np.zeros(len(z))
    if bad >= 0:
        g[:n] = prior * ((s[:n] - 1) - s[:n]) / n
        g[n:] = s[n:] / (len(z) - n)
    else:
        g[:n] = prior * s[:n] / n
        g[n:] = -s[n:] / (len(z) - n)
    return good + max(0.0, bad), g


def apart_gradient(z: np.ndarray, n: int) -> np.ndarray:
    """The logistic loss of telling positives (the first n) from unlabelled rows, both sides weighing the same."""
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return np.concatenate([(s[:n] - 1) / n, s[n:] / (len(z) - n)]) / 2


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> PUModel:
    """The network of least non-negative risk with the logistic loss; the same input gives the same model."""
    return _network(positive, unlabelled, prior, lambda z, n: risk_gradient(z, n, prior)[1], EPOCHS)


def _tail_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of unlabelled over that of positive scores from a threshold on, at the threshold of least upper bound.

    Where only positives score, that ratio is their share among the unlabelled; elsewhere it is more.  The bound keeps the
    threshold away from tails of few rows (the best-bin estimator of mixture proportions).
    """
    at = np.unique(positive)
    q_p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    q_u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    slack = sum(np.sqrt(np.log(4 / PRIOR_DELTA) / (2 * n)) for n in (len(positive), len(unlabelled)))
    best = np.argmin((q_u + slack) / q_p)
    return float(q_u[best] / q_p[best])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, by features of both.

    Each half of the rows is ordered by a network that learned from the other half to tell positives from unlabelled rows;
    the two estimates are averaged and kept within 0.01 and 0.99.
    """
    halves = [(positive[i::2], unlabelled[i::2]) for i in (0, 1)]
    if min(len(x) for half in halves for x in half) < MIN_FOLD:
        return 0.5
    found = []
    for own, other in (halves, halves[::-1]):
        model = _network(*other, 0.5, apart_gradient, PRIOR_EPOCHS)
        found.append(_tail_ratio(model.logits(own[0]), model.logits(own[1])))
    return min(0.99, max(0.01, sum(found) / 2))


def _network(positive: np.ndarray, unlabelled: np.ndarray, prior: float, gradient: Callable[[np.ndarray, int], np.ndarray], epochs: int) -> PUModel:
    """Adam on a gradient of the logits of some positives and then some unlabelled rows."""
    rng = np.random.default_rng(SEED)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    d = both.shape[1]
    params = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    model = PUModel(mean, scale, params, prior)
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    p_all, u_all = (np.clip((a - mean) / scale, -8, 8) for a in (positive, unlabelled))
    for _ in range(epochs):
        u_order = rng.permutation(len(u_all))
        for at in range(0, len(u_order), BATCH):
            u = u_all[u_order[at : at + BATCH]]
            p = p_all[rng.integers(0, len(p_all), min(BATCH, len(p_all)))]
            x = np.concatenate([p, u])
            h = np.tanh(x @ params[0] + params[1])
            z = h @ params[2] + params[3]
            g = gradient(z, len(p))
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads = [x.T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], g.sum()]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.weights = params
    return model


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PUModel | None:
    """Learns from rows that are not held out; None if none of those is labelled 1.

    What comes to the driver is at most MAX_POSITIVE and MAX_UNLABELLED rows of numbers, however many rows share an id.
    """
    known = labels.select(F.col("doc_id").alias("_id"), "quality").filter(~held_out("_id") & F.col("_id").isNotNull() & (F.col("quality") == 1)).select("_id").distinct()
    order = F.xxhash64("_id")
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(~held_out("_id") & F.col("_id").isNotNull())
    # Ids first, texts after: the sort for the sample moves no texts.
    good = known.orderBy(order, "_id").limit(MAX_POSITIVE).withColumn("trusted", F.lit(1))
    plain = base.select("_id").distinct().orderBy(order, "_id").limit(MAX_UNLABELLED).withColumn("trusted", F.lit(0))
    asked = good.unionByName(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], names=["_id", "trusted", "x"])

    # Of rows that share an id, one counts: that of the smallest features.
    rows = base.join(F.broadcast(asked), "_id").select("_id", "trusted", "_text").mapInArrow(run, "_id long, trusted int, x binary").groupBy("_id", "trusted").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["trusted"], r["_id"]))
    sets = [np.array([np.frombuffer(r["x"]) for r in rows if r["trusted"] == t]) for t in (1, 0)]
    return fit(sets[0], sets[1], class_prior(*sets)) if len(sets[0]) and len(sets[1]) else None


def score_documents(docs: DataFrame, model: PUModel | None, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """docs with score_col added; all its columns stay."""
    names, types = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            if model is None:
                score = np.full(b.num_rows, 0.5)
            else:
                score = model.scores(np.array([features(t.as_py()) for t in b.column(at)])) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*names, score_col])
        give_back()

    return docs.mapInArrow(run, types.__class__([*types.fields]).add(score_col, "double"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with the same columns."""
    name = unused("_score", docs.columns)
    return score_documents(docs, train(docs, labels), score_col=name).filter(F.col(name) >= 0.5).drop(name)
