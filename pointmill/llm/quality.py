"""Document quality by Bradley-Terry ranking: scores learned from preference pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import map_arrow
from pointmill.llm.toxicity import training_rows

_LOWER, _UPPER, _DIGIT, _SPACE = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r"
_KINDS = np.zeros((256, 12))
for _row, _set in enumerate((_LOWER, _UPPER, _DIGIT, _SPACE, b".,", b"!?", b"*%&$#@", b"|", b"<>{}[]=\\/", b"\n", bytes(range(128, 256)), b"aeiou")):
    _KINDS[list(_set), _row] = 1


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, word and line statistics, of the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words, lines = raw.split(), [x.strip() for x in raw.split(b"\n") if x.strip()]
    n, m = max(len(raw), 1), max(len(words), 1)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / n
    size = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    low = [w.lower() for w in words]
    count: dict[bytes, int] = {}
    for w in low:
        count[w] = count.get(w, 0) + 1
    top = max(count.values(), default=0) / m
    repeated = sum(a == b for a, b in zip(low, low[1:])) / m
    pairs = len(set(zip(low, low[1:]))) / max(m - 1, 1)
    ends = sum(w[-1:] in b".,!?*%&$|" for w in words) / m
    upper = sum(w.isupper() and len(w) > 1 for w in words) / m
    title = sum(w[:1].isupper() for w in words) / m
    return np.r_[
        kinds, np.sqrt(kinds), np.log1p(m), np.log1p(n), size.mean(), size.std(), np.log1p(size.max()), len(count) / m, np.log1p(len(count)), top,
        repeated, pairs, ends, upper, title, np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), m / max(len(lines), 1) / 50, len(count) / np.sqrt(m),
        float(not words), float(m < 20), float(m < 60),
    ]


@dataclass
class Model:
    """score = sigmoid(slope * (strength - cut) + logit(bar)): `bar` stands at the chosen quantile of strengths."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    squares: np.ndarray
    cut: float
    slope: float
    bar: float = 0.7

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z @ self.weights + (z * z) @ self.squares

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut) + np.log(self.bar / (1 - self.bar)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 400, seed: int = 1) -> Model:
    """Bradley-Terry: P(i preferred to j) = sigmoid(s(i) - s(j)), s linear in features and their squares.

    A pair prefers a row of label 1 to one of label 0; the loss is logistic on the difference of the
    pair's features. The threshold is the quantile of training strengths at the share of label 0, moved
    to the near point that errs least.
    """
    if len(x) == 0 or y.min() == y.max():
        k = x.shape[1] if x.ndim == 2 and x.shape[1] else len(features(""))
        return Model(np.zeros(k), np.ones(k), np.zeros(k), np.zeros(k), 0.0 if len(x) == 0 or y.max() else 1.0, 1.0)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.c_[z, z * z]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, steps + 1):
        part = d[rng.integers(0, pairs, 4096)]
        g = -(part * (1 / (1 + np.exp(np.clip(part @ w, -30, 30))))[:, None]).mean(0) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    order = np.argsort(s)
    wrong = np.cumsum(np.r_[0, np.where(y[order] == 1, 1, -1)])
    near = np.abs(np.arange(len(wrong)) - (y == 0).sum()) <= 0.05 * len(wrong) + 1
    best = np.flatnonzero(near & (wrong == wrong[near].min()))
    at = best[len(best) // 2]
    cut = (s[order[max(at - 1, 0)]] + s[order[min(at, len(s) - 1)]]) / 2
    k = x.shape[1]
    return Model(mean, scale, w[:k], w[k:], float(cut), 1 / max(0.3, float(np.std(s)) / 3))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, modulus: int = 4, held_out: int = 2) -> Model:
    """From at most per_class labelled texts of each class (a documented bound of what reaches the driver)."""
    rows = training_rows(docs, labels, "quality", modulus, held_out, per_class)
    x = np.array([features(t) for t, _ in rows]) if rows else np.zeros((0, len(features(""))))
    return fit(x, np.array([y for _, y in rows], dtype=float))


def score(docs: DataFrame, model: Model, text: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with a score and a 0/1 prediction; columns of those names are replaced, all others stay.

    Null texts count as empty; an empty text has features, hence a score."""
    keep = [c for c in docs.columns if c not in (score_col, predicted_col)]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{score_col}` double", f"`{predicted_col}` int"])

    def run(batch: pa.RecordBatch):
        texts = batch.column(at).to_pylist()
        s = model.score(np.array([features(t) for t in texts])) if texts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= model.bar).astype(np.int32))], names=[*keep, score_col, predicted_col])

    return map_arrow(docs, run, kinds)
