"""Quality classifier: regularised quadratic discriminant analysis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, odds_shift
from .docstats import FEATURES
from .gbt import _rows, labelled_features

_RATIOS = np.array([f.endswith("_ratio") for f in FEATURES])


def transform(x: np.ndarray) -> np.ndarray:
    """Ratios, which crowd at zero, go through a shifted logarithm; the rest stay."""
    return np.where(_RATIOS, np.log(np.maximum(x, 0) + 0.002), x)


class Discriminant:
    """Class densities with shrunk covariances; the inverse Cholesky factors are computed once.

    Of no labels, or one class, every score is the class's (one half without labels).
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, to_pooled: float = 0.3, to_identity: float = 0.05):
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = 0.5 if len(y) == 0 else float(y[0])
            return
        z = transform(x)
        self.centre, self.scale = z.mean(0), z.std(0) + 1e-6
        z = (z - self.centre) / self.scale
        d = z.shape[1]
        own = [z[y == k] for k in (0, 1)]
        pooled = sum((c - c.mean(0)).T @ (c - c.mean(0)) for c in own) / len(z)
        self.mean, self.whiten, self.log_det = [], [], []
        for c in own:
            s = (1 - to_pooled) * np.cov(c.T, bias=True).reshape(d, d) + to_pooled * pooled
            s = (1 - to_identity) * s + to_identity * np.trace(s) / d * np.eye(d)
            low = np.linalg.cholesky(s)
            self.mean.append(c.mean(0))
            self.whiten.append(np.linalg.inv(low))
            self.log_det.append(2 * np.log(np.diag(low)).sum())
        self.slope, self.offset = _platt(self.difference(x), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0, compressed at both ends."""
        z = (transform(x) - self.centre) / self.scale
        far = [(((z - m) @ w.T) ** 2).sum(1) + det for m, w, det in zip(self.mean, self.whiten, self.log_det, strict=True)]
        return np.arcsinh((far[0] - far[1]) / 4)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def _platt(f: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic calibration with Newton steps."""
    w, x = np.array([1.0, 0.0]), np.stack([f, np.ones_like(f)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Fitted on at most per_class labelled documents of either class whose crc32 of the id is not 0 modulo 5. Inputs are
    statistics of the text alone. Null texts count as empty, a null id as empty text in the fold; empty tables give
    no rows, empty labels the score one half; repeated rows are scored alike, other columns are left aside. Whole texts are measured,
    however long, a few at a time. Of labelled rows that share an id, one is learned from.
    """
    x, y = labelled_features(docs, labels, "quality", fold(5) != 0, per_class)
    model = Discriminant(x, y)
    if model.constant is None:
        model.offset += odds_shift(labels, "quality", fold(5) != 0, y)  # the sample has more of the rarer class than the labels have
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def work(batches):
        def made(batch, base, x):
            p = model.score(x)
            return [batch.column("doc_id"), batch.column("held_out"), p, (p >= threshold).astype(np.int32)]

        yield from _rows(batches, schema, made)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(5) == 0).alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
