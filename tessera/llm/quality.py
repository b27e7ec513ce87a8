"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its distinct words, hashed, and the edges that statistics of its
structure and size have passed.  The machine scores b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; by the
sum-of-squares identity the pairs cost as much as one pass over the features:
half of (sum v_i x_i)^2 - sum (v_i x_i)^2, summed over the factors.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import training_rows

WORD_SLOTS = 1 << 14
EDGES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.92, 0.98)
BINS = len(EDGES)
STATS = 12
SLOTS = WORD_SLOTS + STATS * BINS + 1
#: Values of features: all words of a document together weigh as much as one passed edge.
WORD_VALUE, STAT_VALUE = 0.3, 0.3
WORD = re.compile(r"\w+")
#: Documents scored at once.
SCORE_ROWS = 256


def structure(text: str) -> list[float]:
    """Statistics in 0..1 of a whole text; all 0 for an empty one."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * STATS
    lines = [line for line in text.split("\n") if line.strip()]
    letters = sum(map(str.isalpha, tokens))
    upper = sum(map(str.isupper, tokens))
    distinct = len(set(tokens))
    same = sum(a == b for a, b in zip(tokens, tokens[1:]))
    pairs = len(set(zip(tokens, tokens[1:])))
    size = len(text)
    raw = text.encode("utf-8")
    marks = len(raw) - len(raw.translate(None, MARKS))
    return [
        upper / n,
        1 - letters / n,
        1 - distinct / n,
        same / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0,
        min(1.0, 5 * marks / size),
        sum(map(text.count, "|#*%&$")) / size * 5 if size else 0.0,
        tokens.count("|") / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, (size / n) / 24),
        min(1.0, math.log2(size + 1) / 24),
        min(1.0, math.log2(size / max(1, len(lines)) + 1) / 16),
    ]


MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's features: its distinct words, and every edge that one of its
    statistics has passed (so a larger value keeps the features of a smaller one)."""
    words = {crc32(w.encode()) % WORD_SLOTS for w in WORD.findall(text.lower())}
    passed = [WORD_SLOTS + k * BINS + e for k, s in enumerate(structure(text)) for e in range(bisect_right(EDGES, s))]
    slots = np.array([*words, *passed, SLOTS - 1], dtype=np.int32)
    values = np.full(len(slots), STAT_VALUE, dtype=np.float32)
    values[: len(words)] = WORD_VALUE / math.sqrt(max(1, len(words)))
    return slots, values


class FactorisationMachine:
    def __init__(self, slots: int = SLOTS, factors: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(slots, dtype=np.float32)
        self.v = (0.02 * rng.standard_normal((slots, factors))).astype(np.float32)

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the link of rows that begin at ``starts`` (no row is empty), and each row's
        sums of its factors."""
        vx = self.v[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[slots] * values, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(s) for s, _ in rows[:-1])])
        z, _ = self.raw(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int, rate: float, decay: float, batch: int = 256, seed: int = 7) -> None:
        """Adam on the weighted logistic loss."""
        share = float((labels * weights).sum() / weights.sum())
        self.bias = math.log(max(share, 1e-3) / max(1 - share, 1e-3))
        if share <= 0 or share >= 1:  # one label only: its prior is all there is to learn
            return
        rng, weights = np.random.default_rng(seed), weights / weights.mean()
        params = [self.w, self.v]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                some = order[at : at + batch]
                slots, values = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
                sizes = np.array([len(rows[i][0]) for i in some])
                starts = np.cumsum(sizes) - sizes
                z, sums = self.raw(slots, values, starts)
                error = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) * weights[some] / len(some)).astype(np.float32)
                gx = np.repeat(error, sizes) * values
                grads = [np.bincount(slots, gx, minlength=len(self.w)).astype(np.float32), np.empty_like(self.v)]
                gv = gx[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[slots] * values[:, None])
                for f in range(gv.shape[1]):
                    grads[1][:, f] = np.bincount(slots, gv[:, f], minlength=len(self.w))
                step += 1
                self.bias -= rate * float(error.sum())
                for p, g, m, s in zip(params, grads, first, second, strict=True):
                    g += decay * p
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 3000, factors: int = 8, epochs: int = 15, rate: float = 0.02, decay: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fit on at most ``per_class`` labelled rows of each label outside the held-out fold; what
    comes to the driver is their features (slots and values), so it does not grow with the corpus.
    Without rows of both labels the machine gives the prior (0.5 without any)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "weight": batch["weight"], "slots": [s.tobytes() for s, _ in rows], "x": [v.tobytes() for _, v in rows]})

    sample = training_rows(docs, labels, label_col, per_class, id_col, text_col).mapInPandas(run, "id long, label int, weight double, slots binary, x binary").collect()
    sample.sort(key=lambda r: r["id"])
    machine = FactorisationMachine(factors=factors)
    if sample:
        rows = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["x"], np.float32)) for r in sample]
        machine.fit(rows, np.array([r["label"] for r in sample], dtype=np.float64), np.array([r["weight"] for r in sample]), epochs, rate, decay)
    return machine


def score_quality(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: ``id_col``, ``score`` in 0..1, and the columns named in ``keep``.

    The machine has a fixed size and is broadcast; rows pass through one map without a shuffle.
    A null or empty text is scored by its structure alone (all statistics 0); repeated rows are
    scored alike; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    kept = [c for c in keep if c not in (id_col, text_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["__text"].tolist()
            scores = np.concatenate([sent.value.score([features(t or "") for t in texts[k : k + SCORE_ROWS]]) for k in range(0, max(1, len(texts)), SCORE_ROWS)])
            out = batch if text_col in keep else batch.drop(columns=["__text"])
            yield out.assign(__score=scores)

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__k{k}") for k, c in enumerate(kept)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text" or text_col in keep) + ", __score double"
    names = {id_col: "__id", text_col: "__text"} | {c: f"__k{k}" for k, c in enumerate(kept)}
    scored = rows.mapInPandas(run, schema)
    return scored.select(F.col("__id").alias(id_col), *[F.col(names[c]).alias(c) for c in keep if c != id_col], F.col("__score").alias("score"))
