"""A network from vectors to bit probabilities, trained over all rows: tasks sum gradients of their rows, the driver takes the step.

Layers are linear, normalised, GELU (in its tanh form) and dropout, the last one linear; the loss is cross entropy with a weight for each bit's ones; AdamW; training
ends when the loss of held-out rows stops falling. Weights and one gradient are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..store import passing, settled

#: Numbers of a sum that go in one row; rows that a task multiplies at a time.
CHUNK, ROWS = 1 << 16, 1024


@dataclass
class Network:
    """weights: of each hidden layer a matrix, a bias, a scale and a shift, then a matrix and a bias."""

    weights: list[np.ndarray]
    dropout: float = 0.0
    history: list[tuple[float, float]] = field(default_factory=list)

    @classmethod
    def new(cls, width: int, hidden: tuple[int, ...], bits: int, dropout: float, seed: int) -> Network:
        r, weights = np.random.default_rng(seed), []
        for a, b in zip((width, *hidden), hidden, strict=False):
            weights += [r.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b), np.ones(b), np.zeros(b)]
        last = hidden[-1] if hidden else width
        return cls([*weights, r.uniform(-1, 1, (last, bits)) / np.sqrt(last), np.zeros(bits)], dropout)

    def forward(self, x: np.ndarray, names: np.ndarray | None = None, step: int = 0) -> tuple[np.ndarray, list]:
        """Logits, and what backward() needs. With names (a hash of each row) units are dropped, the same ones wherever the row is."""
        kept, w = [], self.weights
        for k in range(0, len(w) - 2, 4):
            z = x @ w[k] + w[k + 1]
            spread = np.sqrt(z.var(axis=1, keepdims=True) + 1e-5)
            unit = (z - z.mean(axis=1, keepdims=True)) / spread
            y = unit * w[k + 2] + w[k + 3]
            tanh = np.tanh(0.7978845608028654 * (y + 0.044715 * y**3))
            mask = np.ones_like(y) if names is None or not self.dropout else dropped(names, y.shape[1], step + k, self.dropout)
            kept.append((x, unit, spread, y, tanh, mask))
            x = 0.5 * y * (1 + tanh) * mask
        kept.append(x)
        return x @ w[-2] + w[-1], kept

    def backward(self, kept: list, g: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights from those of the logits."""
        w, out = self.weights, [kept[-1].T @ g, g.sum(axis=0)]
        g = g @ w[-2].T
        for k in range(len(w) - 6, -1, -4):
            x, unit, spread, y, tanh, mask = kept[k // 4]
            slope = 0.7978845608028654 * (1 + 3 * 0.044715 * y**2)
            g = g * mask * (0.5 * (1 + tanh) + 0.5 * y * (1 - tanh**2) * slope)
            scale, shift, inner = (g * unit).sum(axis=0), g.sum(axis=0), g * w[k + 2]
            g = (inner - inner.mean(axis=1, keepdims=True) - unit * (inner * unit).mean(axis=1, keepdims=True)) / spread
            out = [x.T @ g, g.sum(axis=0), scale, shift, *out]
            g = g @ w[k].T
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[0], -30, 30)))

    def predict(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        """key and probabilities p of each row, a batch at a time; rows of one key stay apart, see evidence.pooled. A null vector is one of zeros."""
        ship(rows.sparkSession)
        net, width = self, len(self.weights[0])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = net.probabilities(_matrix(batch.column("v"), width))
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(list(p), pa.list_(pa.float64()))], names=[key, "p"])

        return rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(work, f"`{key}` {rows.schema[key].dataType.simpleString()}, p array<double>")


def dropped(names: np.ndarray, units: int, step: int, share: float) -> np.ndarray:
    """0 for a dropped unit, 1 / (1 - share) for others, by a hash of the row's name, the unit and the step."""
    z = names.astype(np.uint64)[:, None] + (np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :] + np.uint64(step * 0xD1B54A32D192ED03 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 >= share) / (1 - share)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; what is null or no number is 0. A vector of another length is an error."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        if v is not None:
            if len(v) != width:
                raise ValueError(f"a vector of {len(v)} numbers among those of {width}")
            out[i] = [np.nan if x is None else x for x in v]
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def loss_of(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted cross entropy of each row, summed over its bits, and its gradients by the logits."""
    p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
    loss = weight * y * np.logaddexp(0, -logits) + (1 - y) * np.logaddexp(0, logits)
    return loss.sum(axis=1), (1 - y) * p - weight * y * (1 - p)


def _summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """What work(vectors, bits, names) gives for slices of the rows (an array of size numbers), summed: by tasks, then piece by piece on the executors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                total += work(part.column("v"), part.column("b"), part.column("name").to_numpy())
        pieces = [total[k : k + CHUNK] for k in range(0, size, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], names=["piece", "part"])

    def together(group: pa.Table) -> pa.Table:
        parts = np.stack([np.array(x) for x in sorted(group["part"].to_pylist())])
        return pa.table({"piece": group["piece"].slice(0, 1), "part": pa.array([parts.sum(axis=0)], pa.list_(pa.float64()))})

    found = rows.mapInArrow(each, "piece int, part array<double>").groupBy("piece").applyInArrow(together, "piece int, part array<double>").collect()
    return np.concatenate([np.array(r.part) for r in sorted(found, key=lambda r: r.piece)]) if found else np.zeros(size)


def fit(rows: DataFrame, key: str, vector: str, bits: str, hidden: tuple[int, ...] = (64,), dropout: float = 0.1, epochs: int = 20, batches: int = 4, rate: float = 0.01, decay: float = 1e-4, patience: int = 3, most_weight: float = 50.0, holdout: int = 10, seed: int = 0) -> Network:
    """A network fitted on all rows with vector and bits (arrays of one length each) but one of `holdout` by the hash of the key, whose loss ends the training; the best state is kept.

    An epoch is `batches` steps, each on the rows of a batch, which lie in a folder of their own, so it reads every row once. Null vectors are zeros; rows without bits are left out. A step's gradient
    is the sum over the rows, so it is the same on any cluster but for rounding.
    """
    spark = ship(rows.sparkSession)
    name = F.xxhash64(F.lit(seed), key)
    given = rows.filter(F.col(bits).isNotNull()).select(name.alias("name"), F.col(vector).cast("array<double>").alias("v"), F.col(bits).cast("array<double>").alias("b"))
    given = given.withColumn("batch", F.when(F.pmod(F.shiftright("name", 7), F.lit(holdout)) == 0, -1).otherwise(F.pmod("name", F.lit(batches))).cast("int"))
    sizes = given.agg(F.max(F.size("v")), F.max(F.size("b")), F.count(F.when(F.col("batch") >= 0, 1)), F.count(F.when(F.col("batch") < 0, 1))).first()
    width, n_bits, n, held = (int(x or 0) for x in sizes)
    if not (n and held and width > 0 and n_bits > 0):
        raise ValueError("rows to fit and rows to hold out are needed, with vectors and bits")
    with passing(spark):
        base = settled(given.repartition("batch", F.pmod(F.shiftright("name", 20), F.lit(64))), by=["batch"])
        ones = _summed(base.filter("batch >= 0"), lambda v, b, _: _matrix(b, n_bits).sum(axis=0), n_bits)
        weight = np.clip(np.divide(n - ones, ones, out=np.full(n_bits, most_weight), where=ones > 0), 1.0, most_weight)
        return _train(base, Network.new(width, tuple(hidden), n_bits, dropout, seed), weight, epochs, batches, rate, decay, patience, held)


def gradient(net: Network, rows: DataFrame, weight: np.ndarray, step: int | None) -> tuple[float, int, list[np.ndarray]]:
    """Loss, rows and gradients of the weights, summed over rows (name, v, b). With a step units are dropped."""
    shapes = [w.shape for w in net.weights]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])

    def work(v: pa.Array, b: pa.Array, names: np.ndarray) -> np.ndarray:
        logits, kept = net.forward(_matrix(v, shapes[0][0]), names if step is not None else None, step or 0)
        loss, g = loss_of(logits, _matrix(b, len(weight)), weight)
        return np.concatenate([[loss.sum(), len(loss)], *(x.ravel() for x in net.backward(kept, g))])

    total = _summed(rows, work, int(ends[-1]) + 2)
    return float(total[0]), int(total[1]), [x.reshape(s) for x, s in zip(np.split(total[2:], ends[:-1]), shapes, strict=True)]


def _train(base: DataFrame, net: Network, weight: np.ndarray, epochs: int, batches: int, rate: float, decay: float, patience: int, held: int) -> Network:
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    best, at, step, plain = np.inf, [w.copy() for w in net.weights], 0, np.ones(len(weight))
    stale = 0
    for epoch in range(epochs):
        seen, total = 0, 0.0
        for k in range(batches):
            loss, n, grads = gradient(net, base.filter(F.col("batch") == k), weight, 1000 * (epoch * batches + k))
            if not n:
                continue
            step, seen, total = step + 1, seen + n, total + loss
            for i, g in enumerate(grads):
                g = g / (n * len(weight))
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                net.weights[i] = net.weights[i] * (1 - rate * decay) - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        early = gradient_free_loss(net, base.filter("batch < 0"), plain) / (held * len(weight))
        net.history.append((total / max(1, seen * len(weight)), early))
        if early < best:
            best, at, stale = early, [w.copy() for w in net.weights], 0
        else:
            stale += 1
            if stale >= patience:
                break
    net.weights = at
    return net


def gradient_free_loss(net: Network, rows: DataFrame, weight: np.ndarray) -> float:
    width = len(net.weights[0])
    return float(_summed(rows, lambda v, b, _: np.array([loss_of(net.forward(_matrix(v, width))[0], _matrix(b, len(weight)), weight)[0].sum()]), 1)[0])
