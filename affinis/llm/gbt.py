"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fold, odds_shift, one_per_id, portions, sample_labelled
from .docstats import FEATURES, stats

#: The kept verdict may only fall as these grow.
FALLING = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "bang_ratio", "pipe_ratio")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Trees:
    """Boosted trees as node arrays: tree t has the nodes t * size to (t + 1) * size, children of i are 2 i + 1 and 2 i + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, depth: int, bias: float):
        self.feature, self.threshold, self.value, self.depth, self.bias = feature, threshold, value, depth, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.value) or not len(x):
            return np.full(len(x), self.bias)
        trees = np.arange(len(self.value))[None, :]
        at = np.zeros((len(x), len(self.value)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.bias + self.value[trees, at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, least: float = 20.0, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins.

    sign: 1, 0 or -1 for each feature. A split on a signed feature must order its children so, and the midpoint
    of their values bounds all that grows below, so every tree and the sum of them is monotonic in the feature.
    Of no rows, or one class, the model is a constant.
    """
    size = 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, size), int), np.zeros((0, size)), np.zeros((0, size)), depth, 0.0 if len(y) == 0 else (6.0 if y[0] else -6.0))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    n_bins = bins + 1
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), bias)
    feature, threshold, value = np.zeros((trees, size), np.int64), np.full((trees, size), np.inf), np.zeros((trees, size))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        bound = {0: (-np.inf, np.inf)}
        for level in range(depth):
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                low, high = bound[i]
                rows = np.flatnonzero(node == i)
                best = (1e-6, None)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                whole = np.clip(-total_g / (total_h + ridge), low, high)
                gain_of = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
                for j in range(x.shape[1]) if len(rows) > 2 * least else ():
                    k = binned[rows, j]
                    left_g, left_h, left_n = (np.cumsum(np.bincount(k, w, n_bins))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    vl, vr = np.clip(-left_g / (left_h + ridge), low, high), np.clip(-(total_g - left_g) / (total_h - left_h + ridge), low, high)
                    gain = gain_of(left_g, left_h, vl) + gain_of(total_g - left_g, total_h - left_h, vr) - gain_of(total_g, total_h, whole)
                    gain[(left_n < least) | (len(rows) - left_n < least) | (sign[j] * (vr - vl) < 0)] = -1
                    gain[len(cuts[j]) :] = -1
                    if (b := int(gain.argmax())) < len(cuts[j]) and gain[b] > best[0]:
                        best = (gain[b], (j, b, vl[b], vr[b]))
                bound[2 * i + 1] = bound[2 * i + 2] = (low, high)
                value[t, 2 * i + 1] = value[t, 2 * i + 2] = whole
                if best[1]:
                    j, b, vl, vr = best[1]
                    feature[t, i], threshold[t, i] = j, cuts[j][b]
                    value[t, 2 * i + 1], value[t, 2 * i + 2] = vl, vr
                    if sign[j]:
                        mid = (vl + vr) / 2
                        below, above = (low, mid), (mid, high)
                        bound[2 * i + 1], bound[2 * i + 2] = (below, above) if sign[j] > 0 else (above, below)
                node[rows] = 2 * i + 1 + (x[rows, feature[t, i]] > threshold[t, i])
        value[t] *= rate
        margin += value[t][node]
    return Trees(feature, threshold, value, depth, bias)


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """make(batch, base, features) gives the columns of schema for a portion of a batch, so that few texts are expanded at once."""
    for batch, texts in portions(batches):
        found = [stats(t) for t in texts]
        base = np.array([x[0] for x in found], np.int64).reshape(-1, len(BASE))
        x = np.array([x[1] for x in found], float).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(make(batch, base, x), schema, strict=True)], schema=schema)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, wanted, per_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded sample, computed on the executors; at most 2 * per_class short rows come back, one for each labelled id."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("h", pa.int64()), ("x", pa.list_(pa.float64()))])

    def work(batches):
        yield from _rows(batches, schema, lambda b, base, x: [b.column("doc_id").cast(pa.int64()), b.column("label"), b.column("h"), pa.array(list(x), pa.list_(pa.float64()))])

    rows = sample_labelled(docs, labels, label, wanted, per_class).withColumn("h", F.xxhash64("text")).mapInArrow(work, "doc_id long, label int, h long, x array<double>")
    got = one_per_id(rows, "x", "h").collect()
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    y = np.array([r.label for r in got], float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums then agree between runs
    return x[order], y[order]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = 8000) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, probability for each row of docs.

    The model is fitted on at most per_class labelled documents of either class (labels.quality), outside
    the held-out fold of the ids. Null and empty texts have zero statistics, and fail the base rule; repeated rows
    are scored alike; other columns, and any names they have, are left aside. Empty labels: a constant model; an empty table: no rows.
    Whole texts are measured, however long, a few at a time. Of labelled rows that share an id, one is learned from.
    """
    x, y = labelled_features(docs, labels, "quality", fold(5) != 0, per_class)
    model = fit(x, y, np.array([-1 if f in FALLING else 0 for f in FEATURES]))
    # The sample has more of the rarer class than the labels have; scores go by the labels' share.
    model.bias += odds_shift(labels, "quality", fold(5) != 0, y)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())])

    def work(batches):
        def made(batch, base, x):
            p = model.probability(x)
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            return [batch.column("doc_id").cast(pa.int64()), *base.T, failed, ~failed & (p >= threshold), p]

        yield from _rows(batches, schema, made)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, probability double")
