"""A small learned embedding of feature vectors: two hidden layers, unit-length output, batch-all triplet loss, in numpy.

Training sees a bounded sample (batches of a few identities and windows, at most BATCHES an epoch), so it runs on the driver;
embedding is an Arrow-batched map over the whole table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

LAYERS, MARGIN, DROPOUT, EPOCHS, BATCHES, RATE, DECAY, IDS, ROWS = (256, 128, 32), 0.2, 0.1, 40, 150, 1e-4, 1e-4, 2, 4


class Embedder:
    """Weights with the order of the features they were fitted on."""

    def __init__(self, features: list[str], layers: tuple[int, ...] = LAYERS, seed: int = 0):
        self.features, self.rng = list(features), np.random.default_rng(seed)
        sizes = (len(features), *layers)
        self.weights = [self.rng.uniform(-1, 1, (a, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.biases = [np.zeros(b) for b in sizes[1:]]

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        kept = []
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z = x @ w + b
            last = i == len(self.weights) - 1
            on = np.ones_like(z) if last else (z > 0).astype(float)
            if train and not last:
                on = on * (self.rng.random(z.shape) >= DROPOUT) / (1 - DROPOUT)
            kept.append((x, on))
            x = z * on
        norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return x / norm, [kept, x, norm]

    def embed(self, x: np.ndarray) -> np.ndarray:
        return self.forward(np.asarray(x, float))[0]

    def fit(self, x: np.ndarray, ids: np.ndarray, epochs: int = EPOCHS, batches: int = BATCHES, rate: float = RATE) -> list[float]:
        """Mean loss of each epoch."""
        names = [i for i in np.unique(ids) if (ids == i).sum() >= 2]
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.weights, *self.biases)]
        step, losses = 0, []
        for _ in range(epochs):
            total = []
            for _ in range(batches if len(names) >= 2 else 0):
                pick = self.rng.choice(len(names), min(IDS, len(names)), replace=False)
                rows = np.concatenate([self.rng.choice(np.flatnonzero(ids == names[k]), ROWS, replace=(ids == names[k]).sum() < ROWS) for k in pick])
                out, cache = self.forward(x[rows], train=True)
                loss, grad = triplet_loss(out, ids[rows])
                total.append(loss)
                step += 1
                for k, (p, g) in enumerate(zip((*self.weights, *self.biases), self._backward(cache, out, grad), strict=True)):
                    g = g + DECAY * p
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            losses.append(float(np.mean(total)) if total else float("nan"))
        return losses

    def _backward(self, cache, out: np.ndarray, grad: np.ndarray) -> list[np.ndarray]:
        kept, _, norm = cache
        g = (grad - out * (grad * out).sum(axis=1, keepdims=True)) / norm
        dw, db = [], []
        for (x, on), w in zip(reversed(kept), reversed(self.weights), strict=True):
            g = g * on
            dw.append(x.T @ g)
            db.append(g.sum(axis=0))
            g = g @ w.T
        return [*reversed(dw), *reversed(db)]

    def dumps(self) -> str:
        return json.dumps({"features": self.features, "weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases]})

    @classmethod
    def loads(cls, text: str, features: list[str]) -> Embedder:
        """The saved model; raises if it was fitted on other features or another order of them."""
        d = json.loads(text)
        if d["features"] != list(features):
            raise ValueError("the model's features differ from the table's")
        e = cls(features, tuple(len(b) for b in d["biases"]))
        e.weights, e.biases = [np.array(w) for w in d["weights"]], [np.array(b) for b in d["biases"]]
        return e

    def fingerprint(self) -> str:
        return hashlib.sha256(self.dumps().encode()).hexdigest()[:16]


def triplet_loss(x: np.ndarray, ids: np.ndarray, margin: float = MARGIN) -> tuple[float, np.ndarray]:
    """Mean over all valid triplets, easy ones included, and its gradient."""
    diff = x[:, None] - x[None]
    dist = np.sqrt((diff**2).sum(axis=2) + 1e-12)
    same = ids[:, None] == ids[None]
    valid = (same & ~np.eye(len(ids), dtype=bool))[:, :, None] & ~same[:, None, :]
    gap = dist[:, :, None] - dist[:, None, :] + margin
    active = valid & (gap > 0)
    n = max(1, int(valid.sum()))
    weight = (active.sum(axis=2) - active.sum(axis=1)) / n  # of each distance: as a positive, less as a negative
    pull = (weight / dist)[:, :, None] * diff
    return float(gap[active].sum() / n), pull.sum(axis=1) - pull.sum(axis=0)


def embed_table(rows: DataFrame, model: Embedder, keep: list[str]) -> DataFrame:
    """keep and the embedding of each row's features; null features count as 0."""
    ship(rows.sparkSession)
    text, names = model.dumps(), model.features

    def run(frames: Iterator):
        m = Embedder.loads(text, names)
        for pdf in frames:
            out = pdf[keep].copy()
            out["embedding"] = list(m.embed(pdf[names].fillna(0.0).to_numpy()))
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*dict.fromkeys([*keep, *names])).mapInPandas(run, f"{schema}, embedding array<double>")


def fit_table(rows: DataFrame, features: list[str], pid: str, most_rows: int = 20_000, seed: int = 0, **options) -> Embedder:
    """Fitted on at most most_rows rows, those with the least hash of their values."""
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64(*features), F.lit(1 << 30)) < int(0.9 * most_rows / n * (1 << 30))).limit(most_rows)
    pdf = rows.select(pid, *features).toPandas()
    model = Embedder(features, seed=seed)
    model.fit(pdf[features].fillna(0.0).to_numpy(float), pdf[pid].to_numpy(), **options)
    return model
