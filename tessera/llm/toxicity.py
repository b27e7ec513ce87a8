"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades 0..3 share one weight for each feature and differ in ordered thresholds t1 < t2 < t3:
P(grade <= k) = logistic(t(k+1) - w.x).  The result is the expected grade.  The labels only say
toxic or not, so the grades of toxic training rows come from how many of their words mark toxic
rows (words that hardly occur in the others): one, two or three, and more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import id_text
from tessera.llm.labelled import training_rows

WORD = re.compile(r"[^\W\d_]+")
GRADES = 3
CACHE_WORDS = 300_000


def word_features(word: str) -> tuple[str, ...]:
    """A word, and its beginnings, which inflected forms share."""
    return (word, *(word[:k] + "+" for k in (4, 5, 6) if len(word) > k))


class Rows:
    """Training rows as numbers: each row's distinct words and their counts, and each word's
    features."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.names: list[str] = []  # of features
        self.numbers: dict[str, int] = {}
        self.features: list[tuple[int, ...]] = []  # of each word
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: str) -> None:
        counts = Counter(WORD.findall(text.lower()))
        for w in counts:
            if w not in self.words:
                self.words[w] = len(self.features)
                own = []
                for f in word_features(w):
                    if f not in self.numbers:
                        self.numbers[f] = len(self.names)
                        self.names.append(f)
                    own.append(self.numbers[f])
                self.features.append(tuple(own))
        self.rows.append((np.fromiter(map(self.words.__getitem__, counts), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))))

    def rows_with(self, which: np.ndarray) -> np.ndarray:
        """For each feature, the number of the chosen rows that have it."""
        out = np.zeros(len(self.names))
        for k in np.flatnonzero(which):
            own = {f for w in self.rows[k][0].tolist() for f in self.features[w]}
            out[np.fromiter(own, np.int64, len(own))] += 1
        return out


class OrdinalModel:
    """Weights by feature, thresholds, and a memory of words' weights."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self.words: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self.words.get(w)
        if got is None:
            if len(self.words) >= CACHE_WORDS:
                self.words = {}
            # of a word and its beginnings the strongest counts, so that one word counts once
            got = self.words[w] = max(self.weights.get(f, 0.0) for f in word_features(w))
        return got

    def above(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1..3."""
        z = sum(map(self.word, set(WORD.findall(text.lower()))))
        return 1 / (1 + np.exp(-np.clip(z - np.array(self.thresholds), -40, 40)))


def fit_ordinal(x: list[np.ndarray], features: int, grades: np.ndarray, weights: np.ndarray, rounds: int, rate: float, sparsity: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model by Adam, with weights of 0 or more (every
    feature here marks toxic rows) and a soft threshold on them.
    ``x``: each row's feature numbers; every feature has the value 1."""
    sizes = np.array([len(r) for r in x])
    flat, row = np.concatenate(x).astype(np.int64), np.repeat(np.arange(len(x)), sizes)
    w, cut = np.zeros(features), np.array([1.0, 0.0, 0.0])  # first threshold, logarithms of the gaps
    weights = weights / weights.sum()
    params = [w, cut]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        theta = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
        z = np.bincount(row, w[flat], minlength=len(x))
        upper = np.where(grades < GRADES, logistic(theta[np.minimum(grades, GRADES - 1)] - z), 1.0)
        lower = np.where(grades > 0, logistic(theta[np.maximum(grades - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        fu, fl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gz = weights * (fu - fl)  # of the loss, by z
        gtheta = np.array([-(weights * fu)[grades == k].sum() + (weights * fl)[grades == k + 1].sum() for k in range(GRADES)])
        after = np.cumsum(gtheta[::-1])[::-1]
        grads = [np.bincount(flat, gz[row], minlength=features), np.concatenate([[after[0]], after[1:] * np.exp(cut[1:])])]
        for k, (q, g, m, s) in enumerate(zip(params, grads, first, second, strict=True)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            if k == 0:
                q[:] = np.maximum(q - rate * sparsity, 0)
    return w, cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])


def train(data: Rows, labels: np.ndarray, weights: np.ndarray, candidates: int = 6000, rounds: int = 300, rate: float = 0.1, sparsity: float = 0.005) -> OrdinalModel:
    """Choose features that mark toxic rows, grade those rows, and fit."""
    toxic = labels == 1
    if not toxic.any():
        return OrdinalModel({}, [40.0, 41.0, 42.0])
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    inside, outside = data.rows_with(toxic), data.rows_with(~toxic)
    odds = np.log((inside + 0.2) / (n1 + 0.4)) - np.log((outside + 0.2) / (n0 + 0.4))
    expected = np.maximum((inside + outside) * n1 / (n1 + n0), 0.25)
    beyond = (inside - expected) / np.sqrt(expected)  # standard deviations above chance
    strength = odds * np.sqrt(inside)
    best = np.flatnonzero((inside >= 3) & (odds > 2.0) & (beyond > 4.5))
    best = best[np.argsort(-strength[best], kind="stable")][:candidates]
    if not len(best):
        return OrdinalModel({}, [float(np.log((n0 + 0.5) / (n1 + 0.5))), 41.0, 42.0])
    number = {int(f): k for k, f in enumerate(best)}
    # of a word's features the strongest stands for the word
    mark = np.array([max(((strength[f], number[f]) for f in own if f in number), default=(0, -1))[1] for own in data.features])
    hits = np.array([int(c[mark[w] >= 0].sum()) for w, c in data.rows])
    grades = np.where(toxic, np.where(hits >= 4, 3, np.where(hits >= 2, 2, 1)), 0)
    x = [np.unique(m[m >= 0]) for m in (mark[w] for w, _ in data.rows)]
    w, theta = fit_ordinal(x, len(best), grades, weights, rounds, rate, sparsity)
    return OrdinalModel({data.names[f]: float(w[k]) for f, k in number.items() if w[k]}, theta.tolist())


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``per_class`` labelled rows of each label outside the held-out fold.  Their
    texts come to the driver one after another, and only the numbers of their distinct words
    stay there; the rest of the corpus is not gathered.  Without toxic rows nothing counts as toxic."""
    data, marks, weights = Rows(), [], []
    for r in training_rows(docs, labels, label_col, per_class, id_col, text_col).orderBy("id").toLocalIterator():
        data.add(r["text"])
        marks.append(r["label"])
        weights.append(r["weight"])
    return train(data, np.array(marks), np.array(weights))


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``id_col``, ``severity`` (expected grade, 0 to 3), ``grade`` (the
    likeliest) and ``p_toxic`` (the probability of a grade above 0).

    The model's features are bounded by ``candidates`` and broadcast; rows pass through one map
    without a shuffle.  A null or empty text has no features and gets the thresholds' answer;
    repeated rows are scored alike; an empty table gives an empty result; other columns are
    ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            above = np.array([sent.value.above(t) for t in batch["text"]]).reshape(-1, GRADES)
            each = -np.diff(np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))]), axis=1)
            yield pd.DataFrame({id_col: batch["id"], "severity": above.sum(axis=1), "grade": each.argmax(axis=1), "p_toxic": above[:, 0]})

    return id_text(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` long, severity double, grade int, p_toxic double")
