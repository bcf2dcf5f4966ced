"""Bounded samples of labelled rows, and the small fits made of them on the driver."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents a classifier is fitted on; all documents are scored.
MOST_LABELLED = 3000


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED,
           condition: str = "true") -> DataFrame:
    """At most `most` labelled documents (doc_id, quality, text), chosen by a hash of their id.

    Labels that are null or neither 0 nor 1, and rows without an id, are not used.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("quality").cast("int").alias("quality"))
              .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(condition)
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ascend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam with a falling rate; gradient(values) points uphill."""
    values, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, steps + 1):
        g = gradient(values)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        values += (rate * (1 - (i - 1) / steps) * (mean / (1 - 0.9 ** i))
                   / (np.sqrt(square / (1 - 0.999 ** i)) + 1e-8))
    return values


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.5,
             ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression."""
    share = float(np.clip(y.mean(), 0.01, 0.99))
    start = np.zeros(x.shape[1] + 1)
    start[-1] = np.log(share / (1 - share))

    def gradient(w):
        wrong = y - sigmoid(x @ w[:-1].astype(x.dtype) + w[-1])
        return np.append(wrong.astype(x.dtype) @ x / len(y) - ridge * w[:-1], wrong.mean())

    w = ascend(gradient, start, steps, rate)
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities (two-parameter logistic fit)."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    # Targets a little inside 0 and 1, so that separable margins keep a finite slope.
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    middle, spread = margin.mean(), margin.std() + 1e-9
    x = ((margin - middle) / spread)[:, None]
    (slope,), intercept = logistic(x, target, steps=400, rate=0.3, ridge=0)
    slope = max(slope, 1e-3)
    return slope / spread, intercept - slope * middle / spread
