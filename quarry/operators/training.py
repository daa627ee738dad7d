"""Training by mini-batches: gradients are summed in each task and over tasks; only sums reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


@dataclass
class Config:
    """Steps, batches and the optimiser's numbers; ``batches`` is how many parts an epoch is dealt into."""

    steps: int = 60
    batches: int = 4
    rate: float = 0.1
    floor: float = 0.01
    warm_up: int = 8
    clip: float = 1.0
    decay: float = 0.01
    betas: tuple[float, float] = (0.9, 0.95)
    eval_every: int = 10
    patience: int = 3
    seed: int = 7


@dataclass
class Run:
    """The best weights by validation loss, and what led to them."""

    weights: np.ndarray
    best_step: int = 0
    best_loss: float = math.inf
    history: list[tuple[int, float, float]] = field(default_factory=list)


def rate_at(step: int, c: Config) -> float:
    """Linear warm-up, then a cosine down to the floor."""
    if step < c.warm_up:
        return c.rate * (step + 1) / c.warm_up
    done = (step - c.warm_up) / max(1, c.steps - c.warm_up)
    return c.floor + 0.5 * (c.rate - c.floor) * (1 + math.cos(math.pi * done))


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums of the logistic loss and of its gradient over rows; the last weight is the bias."""
    z = x @ w[:-1] + w[-1]
    loss = np.logaddexp(0, z) - y * z
    d = 1 / (1 + np.exp(-z)) - y
    return float(loss.sum()), np.append(d @ x, d.sum())


def summed(rows: DataFrame, w: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Number of rows (x: array<double>, y), loss and gradient summed over them: one row a place of the gradient and task is shuffled."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(w) + 2)
        for batch in batches:
            if len(batch):
                loss, gradient = loss_and_gradient(np.stack(batch["x"].to_numpy()), batch["y"].to_numpy(), w)
                total += np.concatenate([[len(batch), loss], gradient])
        yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    found = rows.select("x", "y").mapInPandas(scan, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(len(w) + 2)
    for r in found:
        total[r.place] = r.value
    return int(total[0]), total[1], total[2:]


class AdamW:
    """Moments and decoupled decay, which leaves the bias alone."""

    def __init__(self, n: int, c: Config):
        self.c, self.m, self.v, self.t = c, np.zeros(n), np.zeros(n), 0

    def step(self, w: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        norm = math.sqrt(float(gradient @ gradient))
        gradient = gradient * min(1.0, self.c.clip / (norm + 1e-6))
        (b1, b2), self.t = self.c.betas, self.t + 1
        self.m = b1 * self.m + (1 - b1) * gradient
        self.v = b2 * self.v + (1 - b2) * gradient**2
        shrink = np.append(np.full(len(w) - 1, 1 - rate * self.c.decay), 1.0)
        return w * shrink - rate * (self.m / (1 - b1**self.t)) / (np.sqrt(self.v / (1 - b2**self.t)) + 1e-8)


def batch_of(key: str, epoch: int, c: Config):
    """The part of an epoch that a row is in: a draw from its key, dealt anew in each epoch."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(epoch), F.lit(c.seed)), F.lit(c.batches)).cast("int")


def fit(train: DataFrame, validation: DataFrame, key: str, width: int, c: Config | None = None) -> Run:
    """Logistic weights for rows (key, x: ``width`` doubles, y: 0 or 1), stopped when the validation loss no longer improves."""
    c = c or Config()
    train, validation = written(train.select(key, "x", "y"), "training"), written(validation.select("x", "y"), "validation")
    w = np.zeros(width + 1)
    rule, run, bad = AdamW(width + 1, c), Run(w), 0
    for step in range(c.steps):
        epoch, part = divmod(step, c.batches)
        n, loss, gradient = summed(train.where(batch_of(key, epoch, c) == part), w)
        if n:
            w = rule.step(w, gradient / n, rate_at(step, c))
        if (step + 1) % c.eval_every == 0 or step == c.steps - 1:
            m, val, _ = summed(validation, w)
            val = val / m if m else math.inf
            run.history.append((step + 1, loss / n if n else math.nan, val))
            if val < run.best_loss:
                run.weights, run.best_loss, run.best_step, bad = w, val, step + 1, 0
            elif (bad := bad + 1) >= c.patience:
                break
    return run


def hashed_words(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, y and x of rows (doc_id, text, y): the shares of a text's words, by a hash of the word in ``width`` places."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [np.bincount([crc32(w) % width for w in (t or "").lower().encode("utf-8", "replace").split()], minlength=width) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [v / max(1, v.sum()) for v in x]})

    return docs.select("doc_id", "text", "y").mapInPandas(scan, "doc_id long, y double, x array<double>")
