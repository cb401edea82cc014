"""Ranks, normalisations, fusion, gating and pruning inside a query's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Row numbers in the given order, which must decide all ties."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


#: Rows that a task ranks, about.
TASK_ROWS = 1 << 18


def dealt(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """rows, about `count`, dealt by the hash of `by` into as many partitions as give a task TASK_ROWS of them: what a task sorts and adds up stays the same however large the table is.

    Groups and windows of more columns than `by` keep this partitioning, so they need no other shuffle.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS)), *by)


def top_n(rows: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    return ranked(rows, group, *order, name="top_rank").filter(F.col("top_rank") <= n)


def listed(text: Column, separator: str = ";") -> Column:
    """Parts of a candidate list, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def unpivoted(rows: DataFrame, channels: dict[str, str], query: str = "query", key: str = "key", name: str = "rank") -> DataFrame:
    """query, channel, key, rank (or another name) of a frame with a column for each channel; a null is a candidate that the channel hasn't."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(column).cast("double").alias(name)) for c, column in channels.items()]))
    return rows.select(query, key, parts.alias("x")).select(query, "x.channel", key, f"x.{name}").filter(f"{name} is not null")


def completed(fused: DataFrame, manifest: DataFrame, query: str = "query") -> DataFrame:
    """fused with the queries of the manifest that have no candidate, their other columns null."""
    return manifest.select(query).distinct().join(fused, query, "left")


def first_of(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    return top_n(rows, key, 1, *order).drop("top_rank")


def z_score(value: str, group: list[str], sample: bool = True) -> Column:
    """Distance from the mean in standard deviations (n - 1 or n below the root); 0 where there is no spread."""
    w = Window.partitionBy(*group)
    spread = F.coalesce((F.stddev_samp if sample else F.stddev_pop)(value).over(w), F.lit(0.0))
    return F.when(spread > 0, (F.col(value) - F.avg(value).over(w)) / spread).otherwise(0.0)


def min_max(value: str, group: list[str]) -> Column:
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)


def percentile(rank: Column, size: Column) -> Column:
    """rank / size."""
    return rank / F.greatest(size, F.lit(1))


def percentile_from_zero(rank: Column, size: Column) -> Column:
    """(rank - 1) / (size - 1)."""
    return (rank - 1) / F.greatest(size - 1, F.lit(1))


def deduplicated(rows: DataFrame, query: str, channel: str, key: str, rank: str) -> DataFrame:
    """Each channel's first occurrence of a key, ranked anew without gaps."""
    once = rows.groupBy(query, channel, key).agg(F.min(rank).alias(rank))
    return once.withColumn("new_rank", F.row_number().over(Window.partitionBy(query, channel).orderBy(rank, key)))


def rank_fusion(rows: DataFrame, method: str = "rrf", k: float = 60.0, weights: dict[str, float] | None = None, query: str = "query", channel: str = "channel", key: str = "key", rank: str = "rank") -> DataFrame:
    """query, key, score, fused_rank: reciprocal ranks or Borda points, summed over channels after deduplication.

    Ties: first seen (channels in order of name), then key.
    """
    if method not in ("rrf", "borda") or k < 0 or any(v < 0 for v in (weights or {}).values()):
        raise ValueError("unknown method, or a negative constant or weight")
    once = deduplicated(rows, query, channel, key, rank)
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col(channel) == name, float(value)).otherwise(weight)
    size = F.count(F.lit(1)).over(Window.partitionBy(query, channel))
    part = weight / (k + F.col("new_rank")) if method == "rrf" else weight * (size - F.col("new_rank") + 1) / size
    summed = once.withColumn("part", part).groupBy(query, key).agg(F.sum("part").alias("score"), F.min(F.struct(channel, "new_rank")).alias("seen"))
    return ranked(summed, [query], F.round("score", 12).desc(), F.col("seen"), F.col(key), name="fused_rank").drop("seen")


def score_fusion(rows: DataFrame, normalise: str = "zscore", weights: dict[str, float] | None = None, query: str = "query", channel: str = "channel", key: str = "key", score: str = "channel_score") -> DataFrame:
    """query, key, score: weighted sum of scores normalised in each channel; an absent key adds nothing, a score that is not finite is dropped."""
    rows = rows.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    group = [query, channel]
    value = {"zscore": lambda: z_score(score, group, sample=False), "minmax": lambda: min_max(score, group), "none": lambda: F.col(score)}[normalise]()
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col(channel) == name, float(w)).otherwise(weight)
    return rows.withColumn("part", weight * value).groupBy(query, key).agg(F.sum("part").alias("score"))


def union_raw_rank(rows: DataFrame, k: float = 60.0, query: str = "query", channel: str = "channel", key: str = "key", rank: str = "rank") -> DataFrame:
    """Reciprocal ranks where duplicates keep their place: the lowest raw rank of each key and channel counts."""
    once = rows.groupBy(query, channel, key).agg(F.min(rank).alias(rank))
    return once.groupBy(query, key).agg(F.sum(1 / (k + F.col(rank))).alias("score"))


def gated(ranking: DataFrame, spectral: DataFrame, gate: Column) -> DataFrame:
    """query, key, rank, source: the first spectral hit of a query, where the gate holds for it, goes before its ranking; keys once each.

    Queries that only spectral has are left out.
    """
    first = first_of(spectral, ["query"], F.col("rank"), F.col("key")).filter(gate).select("query", "key", F.lit(0).alias("rank"), F.lit("gate").alias("source"))
    first = first.join(ranking.select("query").distinct(), "query", "left_semi")
    both = ranking.select("query", "key", "rank", F.lit("ranker").alias("source")).unionByName(first)
    once = both.groupBy("query", "key").agg(F.min(F.struct("rank", "source")).alias("b")).select("query", "key", F.col("b.rank").alias("old"), "b.source")
    return ranked(once, ["query"], F.col("old"), F.col("key")).drop("old")


def confident(cosine: str = "max_direct", explained: str = "explained", matched: str = "matched", least: tuple[float, float, int] = (0.90, 0.70, 6)) -> Column:
    """The threefold gate of a spectral hit: cosine, explained intensity and matched peaks all reach their least; what is null doesn't."""
    return F.coalesce((F.col(cosine) >= least[0]) & (F.col(explained) >= least[1]) & (F.col(matched) >= least[2]), F.lit(False))


def pruned(rows: DataFrame, primary: Column, wide_rank: str, n: int, order: list[Column]) -> DataFrame:
    """Rows that are primary, or among the n best of the wide ranking; ranks and counts made anew."""
    kept = rows.filter(primary | (F.col(wide_rank) <= n))
    return ranked(kept, ["query"], *order, name="new_rank").withColumn("candidate_count", F.count(F.lit(1)).over(Window.partitionBy("query")))


def systematic(rows: DataFrame, k: int, group: list[str], *order: Column) -> DataFrame:
    """k rows of each group at equal steps of its order: places floor(i (n - 1) / (k - 1)), i from 0 to k - 1; all rows of a group of k or fewer."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = ranked(rows, group, *order, name="__place").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    at, n = F.col("__place") - 1, F.col("__n")
    i = F.ceil(at * (k - 1) / F.greatest(n - 1, F.lit(1)))
    drawn = (i < k) & (F.floor(i * (n - 1) / (k - 1)) == at) if k > 1 else at == 0
    return rows.filter((n <= k) | drawn).drop("__place", "__n")


def draw(key: str, seed: int) -> Column:
    """What a sample goes by: 16 hex digits of the md5 of seed and key, which any engine gives."""
    return F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), "utf-8")), 1, 16)


def hash_sample(rows: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows by the hash of their key: the same draw each time, at any partitioning."""
    return rows.orderBy(draw(key, seed), key).limit(k)


def analog_fusion(rows: DataFrame, weight: float = 0.1, k: float = 60.0) -> DataFrame:
    """Baseline and analog reciprocal ranks, weighted; ties keep the baseline's order. rows: query, key, rank, analog_score."""
    rows = ranked(rows, ["query"], F.col("analog_score").desc(), F.col("rank"), name="analog_rank")
    rows = rows.withColumn("fused", (1 - weight) / (k + F.col("rank")) + weight / (k + F.col("analog_rank")))
    return ranked(rows, ["query"], F.round("fused", 15).desc(), F.col("rank"), name="fused_rank")
