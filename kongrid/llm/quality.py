"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; unlabelled text is a sample of all documents. The share of
positives in unlabelled text (the class prior) is estimated by the best-bin ratio of a first positive-against-unlabelled
model, and the classifier minimises the non-negative unbiased risk. Rows labelled 0 are never used.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import filter_rows, held_out, labelled, map_rows, utf8

# Bounds of the training sample.
POSITIVES, UNLABELLED = 4000, 8000

_SPACE = b" \t\n\r\x0b\x0c"
_FOLLOW = bytes(range(0x80, 0xC0))
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
N_FEATURES = 23


def features(text: bytes) -> list[float]:
    """Shape of a whole text: lengths, shares of character classes, how far words and lines repeat."""
    n = len(text)
    d = max(1, n)

    def count(chars):
        return n - len(text.translate(None, chars))

    tokens = text.split()
    k = max(1, len(tokens))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    points, space = n - count(_FOLLOW), count(_SPACE)
    return [
        np.log1p(len(tokens)), np.log1p(len(lines)), count(_UPPER) / d, count(_LOWER) / d, count(_DIGITS) / d, count(b"#*$%&<>^~") / d, count(b"|") / d, count(b".,;:") / d,
        count(b"!?") / d, space / d, points / d, min(20.0, (points - space) / k), len(set(tokens)) / k, len(set(lines)) / max(1, len(lines)),
        *(min(1.0, 30 * count(x) / d) for x in (b"#*$%&<>^~", b"|", b"!?")), min(1.0, 3 * count(_UPPER) / d), sum(map(eq, tokens, tokens[1:])) / k,
        min(8.0, np.log1p(len(tokens) / max(1, len(lines)))), 100 * count(b"@") / d, 10 * count(b"/") / d, count(b"_{}[]()=\\") / d,
    ]


@dataclass
class PuModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def expand(z: np.ndarray) -> np.ndarray:
    """A constant, the standardised features and their (bounded) squares and magnitudes."""
    z = np.clip(z, -8, 8)
    return np.hstack([np.ones((len(z), 1)), z, np.minimum(z * z, 16) / 4, np.abs(z)])


def _adam(w, gradient, rounds, rate=0.05):
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(scores_p: np.ndarray, scores_u: np.ndarray, delta: float = 0.1) -> float:
    """Upper-tail ratio of unlabelled to positive shares at the threshold with the smallest confidence bound."""
    grid = np.quantile(scores_p, np.linspace(0, 0.95, 96))
    up = 1 - np.searchsorted(np.sort(scores_p), grid) / len(scores_p)
    uu = 1 - np.searchsorted(np.sort(scores_u), grid) / len(scores_u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(scores_u)) + 1 / np.sqrt(len(scores_p)))
    best = int(np.argmin((uu + slack) / np.maximum(up, 1e-9)))
    return float(np.clip(uu[best] / max(up[best], 1e-9), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 600, decay: float = 1e-3) -> PuModel:
    """Logistic loss; where the negative part of the risk falls below 0 its gradient is reversed."""
    both = np.vstack([positive, unlabelled])
    mean, spread = both.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = expand((positive - mean) / spread), expand((unlabelled - mean) / spread)
    even_p, even_u = p[::2], u[::2]
    naive = _adam(np.zeros(p.shape[1]), lambda w: -even_p.T @ _sigmoid(-(even_p @ w)) / len(even_p) + even_u.T @ _sigmoid(even_u @ w) / len(even_u) + decay * w, rounds // 2)
    prior = estimate_prior(p[1::2] @ naive, u[1::2] @ naive) if len(p) > 3 and len(u) > 3 else 0.5

    def gradient(w):
        fp, fu = p @ w, u @ w
        as_positive = -prior * (p.T @ _sigmoid(-fp)) / len(p)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        as_negative = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
        return (as_positive + as_negative if negative >= 0 else -as_negative) + decay * w

    return PuModel(mean, spread, _adam(np.zeros(p.shape[1]), gradient, rounds), prior)


def _collect(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, bound: int) -> np.ndarray:
    texts = docs.join(F.broadcast(ids), docs[id_col] == ids["doc_id"], "left_semi").select(utf8(text_col).alias("text"))
    rows = map_rows(texts, lambda c: [[np.array(features(t)).tobytes() for t in c[0]]], "x binary").limit(bound).collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(-1, N_FEATURES)
    return x[np.lexsort(x.T)]  # the same fit whatever the order of rows


def train_quality(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> PuModel:
    """Fit on at most `positives` trusted and `unlabelled` other documents, chosen by hash of the id outside the held-out quarter.

    Without any trusted positive or any text the model scores every document 0.5.
    """
    trusted = labelled(labels.where("quality = 1"), positives).select("doc_id")
    free = docs.select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id", F.lit("unlabelled"))).limit(unlabelled)
    p, u = _collect(docs, trusted, id_col, text_col, positives), _collect(docs, free, id_col, text_col, unlabelled)
    if not len(p) or not len(u):
        return PuModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(1 + 3 * N_FEATURES), 0.5)
    return fit(p, u)


def score_quality(docs: DataFrame, model: PuModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score in 0 to 1, predicted (1 if score >= threshold).

    The score depends on the whole text alone. Null texts count as empty; empty texts are scored like any other. Rows
    repeated in full give equal rows; other columns are ignored.
    """

    def score(columns):
        keys, texts = columns
        return [keys, model.score(np.array([features(t) for t in texts])).tolist()] if keys else [[], []]

    scored = map_rows(docs.select(id_col, utf8(text_col).alias("_text")), score, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: PuModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score at least the threshold."""
    return filter_rows(docs, utf8(text_col), lambda texts: (model.score(np.array([features(t) for t in texts])) >= threshold).tolist())
