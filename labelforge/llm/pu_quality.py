"""Quality classifier by positive-unlabelled learning.

A logistic model over shape features of the text (character classes and their
transitions, word and line repetition) minimises the non-negative unbiased
risk: trusted positives stand for the positive class, unlabelled web text for
the mixture, and the class prior corrects for the positives inside the
unlabelled sample.  The prior is estimated from the same two samples; no
negative label is read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import column_or_null, documents, fold, hash_sample, label_sample, ship

#: Bounds of the two training samples (rows), from which the class prior is estimated too.
TRAIN_ROWS = 12_000
STEPS = 600
PRIOR_STEPS = 300
CLASSES = 8


def _char_class(c: str) -> int:
    kind = unicodedata.category(c)
    if c in "\n\r":
        return 5
    if c.isspace():
        return 4
    if kind == "Ll":
        return 0
    if kind == "Lu":
        return 1
    if kind[0] in "LM":
        return 2
    if kind[0] == "N":
        return 3
    return 6 if c in ".,;:!?'\"()-" else 7


_CLASS = np.array([_char_class(chr(c)) for c in range(0x3000)], np.uint8)


def features(text: str | None) -> np.ndarray:
    """Shape features of a whole text; NULL counts as empty (all zero)."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < len(_CLASS), _CLASS[np.minimum(codes, len(_CLASS) - 1)], 2)
    n = max(len(kinds), 1)
    single = np.bincount(kinds, minlength=CLASSES) / n
    double = np.bincount(kinds[:-1].astype(np.int64) * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) / n
    words, lines = text.split(), [x for x in text.split("\n") if x]
    counts = Counter(words)
    w = max(len(words), 1)
    odd = sum(k for x, k in counts.items() if not x[-1].isalnum() and x[-1] not in ".,;:!?'\"()")
    rest = [np.log1p(len(text)), len(text) / w, len(counts) / w, max(counts.values(), default=0) / w, odd / w,
            1 - len(set(lines)) / max(len(lines), 1), w / max(len(lines), 1) / 100, min(len(counts) / np.sqrt(w), 50.0)]
    return np.concatenate([np.sqrt(single), np.sqrt(double), rest]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic
    loss by Adam; where the second part is negative, its gradient is climbed.
    Without positives or unlabelled rows the score is the prior everywhere."""
    d = (positive if len(positive) else unlabelled).shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))

    def gradient(theta: np.ndarray) -> np.ndarray:
        zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        wrong = su / len(u)  # derivative of the unlabelled rows' loss as negatives
        back = -prior * sp / len(p)
        if negative >= 0:
            gp, gu = back + prior * (sp - 1) / len(p), wrong
        else:
            gp, gu = -back, -wrong
        return np.append(p.T @ gp + u.T @ gu + decay * theta[:-1], gp.sum() + gu.sum())

    theta = _descend(gradient, d + 1, steps, rate)
    return Model(mean, scale, theta[:-1], float(theta[-1]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = PRIOR_STEPS, seed: int = 3, slack: float = 0.01,
                   doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, from positives and unlabelled rows alone.

    A logistic model is fitted to tell one half of the positives from one half of
    the unlabelled rows.  Above any score, the unlabelled half's share over the
    positive half's is at least the prior, and equal to it where no negative
    scores so high.  The score taken has the least upper confidence bound of that
    ratio ("best bin").  Each half is scored by the model of the other; the two
    estimates are averaged.  Samples of fewer than four rows are not halved;
    without positives or unlabelled rows the prior is zero."""
    if not len(positive) or not len(unlabelled):
        return 0.0
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    rng, halves = np.random.default_rng(seed), []
    for x in (positive, unlabelled):
        z = np.clip((x - mean) / scale, -6, 6)[rng.permutation(len(x))]
        halves.append((z[::2], z[1::2]) if len(z) >= 4 else (z, z))
    (pa, pb), (ua, ub) = halves
    return (_best_bin(pa, ua, pb, ub, steps, slack, doubt) + _best_bin(pb, ub, pa, ua, steps, slack, doubt)) / 2


def _best_bin(p: np.ndarray, u: np.ndarray, p_held: np.ndarray, u_held: np.ndarray, steps: int, slack: float, doubt: float) -> float:
    """The prior by a model fitted on ``p`` and ``u`` and scores of the held rows."""
    def gradient(theta: np.ndarray) -> np.ndarray:
        gp = (_sigmoid(p @ theta[:-1] + theta[-1]) - 1) / len(p)
        gu = _sigmoid(u @ theta[:-1] + theta[-1]) / len(u)
        return np.append(p.T @ gp + u.T @ gu + 1e-3 * theta[:-1], gp.sum() + gu.sum())

    theta = _descend(gradient, p.shape[1] + 1, steps, 0.03)
    of_p, of_u = np.sort(p_held @ theta[:-1]), np.sort(u_held @ theta[:-1])
    cuts = np.unique(of_p)
    share_p = 1 - np.searchsorted(of_p, cuts) / len(of_p)
    share_u = 1 - np.searchsorted(of_u, cuts) / len(of_u)
    error = np.sqrt(np.log(4 / doubt) / 2 / len(of_u)) + np.sqrt(np.log(4 / doubt) / 2 / len(of_p))
    best = np.argmin((share_u + (1 + slack) * error) / share_p)
    return float(min(share_u[best] / share_p[best], 1.0))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _descend(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero."""
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        grad = gradient(theta)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def _vectors(df: DataFrame) -> np.ndarray:
    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(t).tobytes(), na_action=None)

    rows = sorted(df.select(vector("text").alias("x")).toArrow().column("x").to_pylist())
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64) if rows else np.zeros((0, len(features(""))))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_fold: Column, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``rows`` trusted positives and ``rows`` unlabelled
    documents of the training fold.  The class prior is estimated from these two
    samples and kept between 0.01 and 0.99.  Where an id has several labels, the
    largest counts."""
    ship(spark)
    trusted = labels.where(column_or_null(labels, "quality", "int") == 1)
    sample, _, _ = label_sample(spark, docs, trusted, "quality", train_fold, rows)
    texts = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text")).where(train_fold)
    positive, unlabelled = _vectors(sample), _vectors(hash_sample(texts, rows, 11))
    return fit_nnpu(positive, unlabelled, min(max(estimate_prior(positive, unlabelled), 0.01), 0.99))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability of label 1 for each whole text, NULL and empty ones too."""
    ship(spark)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        vectors = np.empty((len(text), len(model.mean)), np.float32)
        for i, t in enumerate(text):
            vectors[i] = features(t)
        return pd.Series(model.score(vectors))

    return score(text)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, cut: float = 0.5) -> DataFrame:
    """``row, doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels are learned only from rows outside the held-out fold; a NULL id is
    in neither.  Only label 1 is read.  NULL and empty texts get the score of an
    empty text; repeated rows get equal scores; an empty table gives an empty
    result."""
    model = train(spark, docs, labels, F.col("doc_id").isNotNull() & ~fold(modulus, remainder))
    base = documents(docs, "doc_id", "text")
    return (base.select("row", "doc_id", fold(modulus, remainder).alias("held_out"), score_column(spark, model, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))
