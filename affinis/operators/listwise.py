"""List-wise ranking: boosted trees on lambda gradients, which weigh a pair by what swapping it would change in the query's NDCG.

Gradients come from windows over the queries, histograms of them are summed on the executors, and the driver gets a number for each node, feature and bin, from
which it finds the splits. No query is held in memory, and no row comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..store import passing
from . import ranking

#: NDCG is measured at these ranks; the last but one ends the training.
CUTOFFS = (1, 5, 10, 25)


@dataclass
class Tree:
    """Nodes in heap order: the children of i are 2 i + 1 and 2 i + 2. A node with feature -1 is a leaf; bins above cut go right. gain: of each split."""

    feature: list[int]
    cut: list[int]
    value: list[float]
    gain: list[float]
    depth: int

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        feature, cut = np.array(self.feature), np.array(self.cut)
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[node]))
        return node


@dataclass
class Ranker:
    """features in the order of the bins; cuts of each; trees; gains and splits of each feature; what each tree lowered the objective by; NDCG of the held-out queries before each tree and after the last."""

    features: list[str]
    cuts: list[list[float]] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    splits: list[int] = field(default_factory=list)
    drops: list[float] = field(default_factory=list)
    ndcg: list[list[float]] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """What is no number counts as 0."""
        values = np.where(np.isfinite(values), values, 0.0)
        return np.stack([np.searchsorted(c, values[:, i], side="left") for i, c in enumerate(self.cuts)], axis=1).astype(np.uint8) if self.cuts else np.zeros((len(values), 0), np.uint8)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees:
            out += np.array(t.value)[t.leaves(bins)]
        return out

    def score(self, rows: DataFrame, name: str = "ranker_score") -> DataFrame:
        """rows with a score. Columns that are missing are an error, which names them."""
        _require(rows, self.features)
        if name in rows.columns:
            raise ValueError(f"the rows have a column {name}")
        ship(rows.sparkSession)
        model, names = self, rows.columns
        given = rows.select(*[F.col(f"`{c}`") for c in names], *_features(self.features))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = model.binned(_matrix(batch, len(model.features)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(model.scores(bins))], names=[*names, name])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return given.mapInArrow(work, f"{types}, `{name}` double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """feature, gain, splits: what the splits of a feature lowered the objective by, and how many they are."""
        return spark.createDataFrame([(f, float(g), int(n)) for f, g, n in zip(self.features, self.gain, self.splits, strict=True)], "feature string, gain double, splits long")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: list[str] | None = None) -> Ranker:
        """The model at path; where features are given, other ones or another order are an error."""
        model = json.loads("".join(r[0] for r in spark.read.text(path).collect()))
        model["trees"] = [Tree(**t) for t in model["trees"]]
        if features is not None and features != model["features"]:
            raise ValueError(f"the model has the features {model['features']}")
        return cls(**model)


def _require(rows: DataFrame, columns: list[str]) -> None:
    if missing := sorted(set(columns) - set(rows.columns)):
        raise ValueError(f"missing columns: {missing}")


def _features(names: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(names)]


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([batch.column(f"__f{i}").to_numpy(zero_copy_only=False) for i in range(n)], axis=1) if n else np.zeros((len(batch), 0))


def lambdas(rows: DataFrame, sigma: float = 1.0) -> DataFrame:
    """rows (query, key, target, score) with place, g and h: the first and second derivative of the list-wise loss by the score.

    The one positive of a query meets each other candidate, weighed by |1 / log2(1 + place) - 1 / log2(1 + its place)|, which is what a swap changes in the NDCG; a
    query without a positive has no gradient. Windows spill, so a query may have any number of candidates.
    """
    own = Window.partitionBy("query")
    gain = lambda place: F.lit(np.log(2.0)) / F.log1p(place)  # noqa: E731  1 / log2(1 + place)
    placed = rows.withColumn("place", F.row_number().over(own.orderBy(F.col("score").desc(), "key")))
    best = F.max(F.when(F.col("target") == 1, F.struct("score", "place"))).over(own)
    placed = placed.withColumn("__p", best)
    rho = 1 / (1 + F.exp(sigma * (F.col("__p.score") - F.col("score"))))
    weight = F.abs(gain(F.col("__p.place")) - gain(F.col("place")))
    other = (F.col("target") == 0) & F.col("__p").isNotNull()
    placed = placed.withColumn("__g", F.when(other, sigma * rho * weight).otherwise(0.0)).withColumn("__h", F.when(other, sigma * sigma * rho * (1 - rho) * weight).otherwise(0.0))
    sums = {c: F.when(F.col("target") == 1, s * F.sum(c).over(own)).otherwise(F.col(c)) for c, s in (("__g", -1), ("__h", 1))}
    return placed.select("*", sums["__g"].alias("g"), sums["__h"].alias("h")).drop("__p", "__g", "__h")


def fit(rows: DataFrame, features: list[str], trees: int = 50, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: int = 20, patience: int = 10, holdout: int = 5) -> Ranker:
    """A ranker of rows (query, key, target 0 or 1, the features): at most `trees` trees, until the held-out NDCG at 10 has not grown for `patience` of them; the best number of trees is kept.

    Queries without a positive teach nothing and are left out; several positives in a query, and other targets, are errors. One query of `holdout`, by its hash, is held out. Features are
    cut at `bins` quantiles at most; a leaf has `least` rows or more. What a step writes is removed after it.
    """
    spark = ship(rows.sparkSession)
    _require(rows, ["query", "key", "target", *features])
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    counts = rows.groupBy("query").agg(F.sum(F.col("target").cast("long")).alias("n"), F.count(F.lit(1)).alias("size"), F.max(F.coalesce(~F.col("target").isin(0, 1), F.lit(True))).alias("odd"))
    seen = counts.agg(F.coalesce(F.max("odd"), F.lit(False)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.when(F.col("n") == 1, F.col("size")))).first()
    if seen[0] or seen[1] > 1:
        raise ValueError("targets must be 0 or 1, with one positive in a query at most")
    if seen[2] < 2:
        raise ValueError("at least two queries with a positive are needed")
    with passing(spark):
        return _fit(rows.join(counts.filter("n = 1").select("query"), "query", "left_semi"), Ranker(list(features)), trees, depth, rate, bins, ridge, least, patience, holdout, seen[3])


def _value(tree: Tree, i: int = 0) -> Column:
    """A row's value by the tree, from its columns __b0, __b1, ..."""
    if tree.feature[i] < 0:
        return F.lit(tree.value[i])
    return F.when(F.col(f"__b{tree.feature[i]}") > tree.cut[i], _value(tree, 2 * i + 2)).otherwise(_value(tree, 2 * i + 1))


def _fit(rows: DataFrame, model: Ranker, trees: int, depth: int, rate: float, bins: int, ridge: float, least: int, patience: int, holdout: int, size: int) -> Ranker:
    n = len(model.features)
    given = rows.select("query", "key", F.col("target").cast("int").alias("target"), (F.pmod(F.xxhash64("query"), F.lit(holdout)) == 0).alias("held"), *_features(model.features))
    finite = given.select("query", "key", "target", "held", *[F.when(F.abs(f"__f{i}") < float("inf"), F.col(f"__f{i}")).otherwise(0.0).alias(f"__f{i}") for i in range(n)])
    cuts = finite.approxQuantile([f"__f{i}" for i in range(n)], [i / bins for i in range(1, bins)], 0.1 / bins) if n else []
    model.cuts = [sorted(set(c)) for c in cuts]
    model.gain, model.splits = [0.0] * n, [0] * n
    names = ["query", "key", "target", "held", "bins", *[f"__b{i}" for i in range(n)]]
    kinds = "`query` {0}, `key` {1}, target int, held boolean, bins binary".format(*(rows.schema[c].dataType.simpleString() for c in ("query", "key")))

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.binned(_matrix(batch, n))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([r.tobytes() for r in made], pa.binary()), *(pa.array(c, pa.int16()) for c in made.T)], names=names)

    binned = finite.mapInArrow(bin_rows, ", ".join([kinds, *(f"__b{i} smallint" for i in range(n))]))
    # Dealt by query once: the windows of all trees find their queries where they lie, and only sort.
    base = ranking.dealt(binned, size, "query").persist(StorageLevel.DISK_ONLY)
    try:
        base.count()
        return _boosted(base, model, trees, depth, rate, bins, ridge, least, patience)
    finally:
        base.unpersist()


def _boosted(base: DataFrame, model: Ranker, trees: int, depth: int, rate: float, bins: int, ridge: float, least: int, patience: int) -> Ranker:
    n, best = len(model.features), 0
    while True:
        score = F.lit(0.0)
        for t in model.trees:
            score = score + _value(t)
        now = lambdas(base.withColumn("score", score)).select("held", "target", "place", "g", "h", "bins").persist(StorageLevel.DISK_ONLY)
        try:
            model.ndcg.append(_ndcg(now))
            if model.ndcg[-1][-2] > model.ndcg[best][-2]:
                best = len(model.trees)
            if len(model.trees) == trees or len(model.trees) - best >= patience:
                break
            grown = _grow(now.filter("NOT held"), model, depth, rate, bins, ridge, least)
        finally:
            now.unpersist()
        if grown is None:
            break
        tree, gain, splits, drop = grown
        model.trees.append(tree)
        model.drops.append(drop)
        for f, g, k in zip(range(n), gain, splits, strict=True):
            model.gain[f] += float(g)
            model.splits[f] += int(k)
    return _cut_back(model, best)


def _cut_back(model: Ranker, best: int) -> Ranker:
    """The model with its first `best` trees; gains and splits are those of these trees."""
    gone = model.trees[best:]
    for t in gone:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                model.gain[f] -= g
                model.splits[f] -= 1
    model.trees, model.drops = model.trees[:best], model.drops[:best]
    return model


def _ndcg(now: DataFrame) -> list[float]:
    """Of the held-out queries at CUTOFFS, 0 where there are none. Each has one positive, so its NDCG is 1 / log2(1 + place)."""
    at = [F.avg(F.when(F.col("place") <= c, F.lit(np.log(2.0)) / F.log1p("place")).otherwise(0.0)) for c in CUTOFFS]
    return [x or 0.0 for x in now.filter("held AND target = 1").agg(*at).first()]


def histograms(now: DataFrame, tree: Tree, features: int, bins: int) -> np.ndarray:
    """(nodes, features, bins, 3): sums of g, h and rows of the nodes at the tree's depth, summed by the executors."""
    nodes, first = 1 << tree.depth, (1 << tree.depth) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, nodes * features * bins))
        for batch in batches:
            made = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), features)
            node = tree.leaves(made) - first
            on = np.flatnonzero(node >= 0)
            slot = ((node[on, None] * features + np.arange(features)) * bins + made[on]).ravel()
            for k, w in enumerate((batch.column("g").to_numpy()[on], batch.column("h").to_numpy()[on], np.ones(len(on)))):
                total[k] += np.bincount(slot, np.repeat(w, features), total.shape[1])
        some = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in total)], names=["slot", "g", "h", "n"])

    sums = now.select("bins", "g", "h").mapInArrow(work, "slot long, g double, h double, n double").groupBy("slot").agg(F.sum("g"), F.sum("h"), F.sum("n"))
    out = np.zeros((nodes * features * bins, 3))
    for r in sums.collect():
        out[r[0]] = r[1:]
    return out.reshape(nodes, features, bins, 3)


def _grow(now: DataFrame, model: Ranker, depth: int, rate: float, bins: int, ridge: float, least: int):
    """(tree, gains, splits, drop) of the next tree, or None where nothing can be split."""
    n = len(model.features)
    size = (2 << depth) - 1
    tree = Tree([-1] * size, [0] * size, [0.0] * size, [0.0] * size, 0)
    worth = lambda g, h: 0.5 * g * g / (h + ridge)
    sums: dict[int, np.ndarray] = {}
    root = None
    for level in range(depth):
        found = histograms(now, tree, n, bins) if n else np.zeros((1 << level, 0, bins, 3))
        for k in range(1 << level):
            i = (1 << level) - 1 + k
            if not n or not found[k].any():
                continue
            total = found[k, 0].sum(axis=0)
            sums.setdefault(i, total)
            root = total if root is None else root
            left = np.cumsum(found[k], axis=1)
            right = total - left
            gain = worth(left[..., 0], left[..., 1]) + worth(right[..., 0], right[..., 1]) - worth(total[0], total[1])
            gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, 0.0)
            f, c = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, c] > 1e-12:
                tree.feature[i], tree.cut[i], tree.gain[i] = int(f), int(c), float(gain[f, c])
                sums[2 * i + 1], sums[2 * i + 2] = left[f, c], right[f, c]
        tree.depth = level + 1
        if not any(f >= 0 for f in tree.feature[(1 << level) - 1 : (2 << level) - 1]):
            break
    if tree.feature[0] < 0:
        return None
    drop = -worth(root[0], root[1])
    for i, s in sums.items():
        if tree.feature[i] < 0:
            tree.value[i] = float(-rate * s[0] / (s[1] + ridge))
            drop += worth(s[0], s[1])
    split = [f for f in tree.feature if f >= 0]
    return tree, np.bincount(split, [g for f, g in zip(tree.feature, tree.gain, strict=True) if f >= 0], n), np.bincount(split, minlength=n), float(drop)


def ranked(rows: DataFrame, model: Ranker) -> DataFrame:
    """rows with ranker_score and final_rank inside their query; ties go by mass_rank where there is one, then by key."""
    order = [F.col("mass_rank")] if "mass_rank" in rows.columns else []
    return ranking.ranked(model.score(rows), ["query"], F.col("ranker_score").desc(), *order, F.col("key"), name="final_rank")
