"""Ranking metrics, recall reports, failure classes, sweeps, leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 25)


def truth_ranks(manifest: DataFrame, ranking: DataFrame) -> DataFrame:
    """query, truth, rank of every query of the manifest; null where the truth is not ranked."""
    hit = ranking.join(manifest, "query").filter(F.col("key") == F.col("truth")).groupBy("query").agg(F.min("rank").alias("rank"))
    return manifest.join(hit, "query", "left")


def rank_metrics(ranks: DataFrame, k: int = 25) -> DataFrame:
    """One row: queries, mrr, hits at CUTOFFS, median rank of the found, share of misses. Queries without candidates count."""
    found = F.when(F.col("rank") <= k, F.col("rank"))
    hits = [F.avg(F.coalesce((F.col("rank") <= c).cast("double"), F.lit(0.0))).alias(f"hits_{c}") for c in CUTOFFS]
    return ranks.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce(1.0 / found, F.lit(0.0))).alias("mrr"), *hits, F.median(found).alias("median_rank"), F.avg(found.isNull().cast("double")).alias("missed"))


def recall(ranks: DataFrame, cutoffs: list[int], group: list[str] | None = None) -> DataFrame:
    """cutoff, recall, queries for each group. One pass; cutoffs multiply rows after, not before, the aggregate."""
    parts = [F.avg(F.coalesce((F.col("rank") <= c).cast("double"), F.lit(0.0))).alias(f"r{c}") for c in cutoffs]
    wide = ranks.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("queries"), *parts)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"r{c}").alias("recall")) for c in cutoffs]))
    return wide.select(*(group or []), "queries", rows.alias("x")).select(*(group or []), "queries", "x.*")


def stratified(ranks: DataFrame, strata: list[str], cutoffs: list[int]) -> DataFrame:
    """stratum, level, cutoff, recall, queries; null levels are unknown."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("level")) for s in strata]))
    return recall(ranks.select("rank", pairs.alias("p")).select("rank", "p.*"), cutoffs, ["stratum", "level"])


def failures(ranks: DataFrame, present: str = "present", k: int = 25) -> DataFrame:
    """query, category: absent from the database, missed by the candidates, ranked below k, or a hit, in this order."""
    category = F.when(~F.col(present), "absent").when(F.col("rank").isNull(), "missed").when(F.col("rank") > k, f"below_{k}").otherwise("hit")
    return ranks.withColumn("category", category)


def threshold_sweep(rows: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """threshold, n, coverage, precision (null where nothing passes), in one pass over rows."""
    wide = rows.agg(F.count(F.lit(1)).alias("total"), *[F.sum((F.col(score) >= t).cast("long")).alias(f"n{i}") for i, t in enumerate(thresholds)], *[F.sum(((F.col(score) >= t) & F.col(correct)).cast("long")).alias(f"c{i}") for i, t in enumerate(thresholds)])
    parts = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"c{i}").alias("c")) for i, t in enumerate(thresholds)]))
    return wide.select("total", parts.alias("x")).select("x.threshold", "x.n", (F.col("x.n") / F.col("total")).alias("coverage"), F.when(F.col("x.n") > 0, F.col("x.c") / F.col("x.n")).alias("precision"))


def in_several_folds(rows: DataFrame, key: str, fold: str) -> DataFrame:
    """Keys that more than one fold has: a leak."""
    return rows.groupBy(key).agg(F.count_distinct(fold).alias("folds")).filter("folds > 1")


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, nulls, n_distinct, n_rows: all columns in one aggregate."""
    aggs = [x for c in columns for x in (F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__0"), F.count_distinct(c).alias(f"{c}__d"))]
    wide = rows.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__0").alias("nulls"), F.col(f"{c}__d").alias("n_distinct")) for c in columns]))
    return wide.select("n_rows", parts.alias("x")).select("x.*", "n_rows")


def auroc(rows: DataFrame, group: list[str], score: str, label: Column) -> DataFrame:
    """Area under the curve from rank sums, ties at their mean rank."""
    counts = rows.groupBy(*group, score).agg(F.sum(label.cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mean_rank = below + (F.col("n") + 1) / 2
    sums = counts.withColumn("r", F.col("pos") * mean_rank).groupBy(*group).agg(F.sum("r").alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return sums.select(*group, F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auroc"))


def described(rows: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """column, min, median, mean, max, n (not null) of each column, for each group; one aggregate for all. Medians are exact."""
    wide = rows.groupBy(*(group or [])).agg(*[F.struct(F.min(c).cast("double").alias("min"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.max(c).cast("double").alias("max"), F.count(c).alias("n")).alias(f"{c}__d") for c in columns])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__d").alias("d")) for c in columns]))
    return wide.select(*(group or []), parts.alias("x")).select(*(group or []), "x.column", "x.d.*")


def frequencies(rows: DataFrame, value: str, least: int = 1) -> DataFrame:
    """value, n of values that occur `least` times or more, the most frequent first."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.col("n").desc(), value)


def element_frequencies(rows: DataFrame, values: str) -> DataFrame:
    """element, n, share over all elements of an array column."""
    counts = rows.select(F.explode(values).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.select("element", "n", (F.col("n") / F.lit(total)).alias("share"))


def repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_distinct of the columns together, by their values and not by a hash, and surplus, the rows beyond the first of each."""
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def group_counts(rows: DataFrame, group: list[str], positive: Column) -> DataFrame:
    """n and positives of each group."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(positive, F.lit(False)).cast("long")).alias("positives"))


def membership_recall(ranks: DataFrame, members: DataFrame, cutoffs: list[int], group: str) -> DataFrame:
    """Recall of each group; a query counts in every group that it is a member of, once. members: query, group, rows may repeat."""
    return recall(ranks.join(members.select("query", group).distinct(), "query"), cutoffs, [group])


def channel_recall(manifest: DataFrame, hits: DataFrame, cutoffs: list[int], k: float = 60.0, union: str = "rrf_union") -> DataFrame:
    """channel, cutoff, recall, queries: each channel, where every query counts, and the fusion of all by reciprocal raw ranks as `union`. hits: query, channel, key, rank."""
    from .ranking import ranked, union_raw_rank

    once = hits.groupBy("query", "channel", "key").agg(F.min("rank").alias("rank"))
    fused = ranked(union_raw_rank(hits, k), ["query"], F.round("score", 12).desc(), F.col("key")).select("query", F.lit(union).alias("channel"), "key", "rank")
    both = once.unionByName(fused)
    names = sorted(r.channel for r in hits.select("channel").distinct().collect())  # a handful
    found = both.join(manifest, "query").filter("key = truth").groupBy("query", "channel").agg(F.min("rank").alias("rank"))
    everywhere = manifest.select("query", F.explode(F.array(*map(F.lit, [*names, union]))).alias("channel"))
    ranks = everywhere.join(found, ["query", "channel"], "left")
    return recall(ranks, cutoffs, ["channel"])


def gate_sweep(manifest: DataFrame, ranking: DataFrame, top: DataFrame, thresholds: list[float], holds: Column, k: int = 25) -> DataFrame:
    """threshold, gated, precision, mrr: what putting a query's spectral hit first does, for each threshold of its confidence.

    ranking: query, key, rank; top: query, key, confidence of the best hit, and what `holds` looks at. Only the truth's rank is followed: a gated hit is
    the truth, or stands before it, or was before it already. One pass for all thresholds.
    """
    truth = manifest.join(ranking.select("query", "key", "rank"), (manifest["query"] == ranking["query"]) & (manifest["truth"] == ranking["key"]), "left").groupBy(manifest["query"], "truth").agg(F.min("rank").alias("rank"))
    gate = top.filter(holds).groupBy("query").agg(F.max(F.struct("confidence", "key")).alias("g")).select("query", "g.confidence", F.col("g.key").alias("gate_key"))
    own = gate.join(ranking, (gate["query"] == ranking["query"]) & (gate["gate_key"] == ranking["key"]), "left").groupBy(gate["query"], "confidence", "gate_key").agg(F.min("rank").alias("gate_rank"))
    rows = truth.join(own, "query", "left")
    right = F.col("gate_key") == F.col("truth")
    moved = F.when(right, 1).otherwise(F.col("rank") + F.when(F.col("gate_rank") < F.col("rank"), 0).otherwise(1))
    value = lambda r: F.when(r <= k, 1.0 / r).otherwise(0.0)
    open_ = lambda t: F.coalesce(F.col("confidence") >= t, F.lit(False))
    aggs = [F.struct(F.lit(float(t)).alias("threshold"), F.sum(open_(t).cast("long")).alias("gated"), (F.sum((open_(t) & right).cast("long")) / F.nullif(F.sum(open_(t).cast("long")), F.lit(0))).alias("precision"), F.avg(F.coalesce(value(F.when(open_(t), moved).otherwise(F.col("rank"))), F.lit(0.0))).alias("mrr")) for t in thresholds]
    return rows.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def bit_metrics(rows: DataFrame, p: str, bits: str, eps: float = 1e-7) -> DataFrame:
    """One row: bce (mean cross entropy over all bits) and tanimoto (mean binary Tanimoto similarity at one half) of predictions."""
    from .kernels import compatibility

    c = rows.select(compatibility(F.col(p), F.col(bits), eps).alias("c"))
    return c.agg(F.avg("c.bce").alias("bce"), F.avg("c.binary_tanimoto").alias("tanimoto"))


def variable_bits(rows: DataFrame, bits: str, most: int = 128) -> DataFrame:
    """bit, share of the bits that are neither always set nor never, at most `most` of them at equal steps."""
    from .ranking import systematic

    shares = rows.select(F.posexplode(bits).alias("bit", "b")).groupBy("bit").agg(F.avg(F.col("b").cast("double")).alias("share")).filter("share > 0 AND share < 1")
    return systematic(shares.withColumn("all", F.lit(0)), most, ["all"], F.col("bit")).drop("all")


def inspection(rows: DataFrame, numbers: list[str], keys: list[str], lists: list[str] = (), examples: int = 10) -> dict:
    """Profile of a table as a report: nulls and distinct values of the keys, their most frequent values, statistics of the numbers, elements of the lists; `examples` values of each at most."""
    of = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  each frame is a row for each column, or `examples` rows
    return {
        "columns": of(profile(rows, [*numbers, *keys])), "numbers": of(described(rows, numbers)),
        "values": {k: of(frequencies(rows, k).limit(examples)) for k in keys},
        "elements": {c: of(element_frequencies(rows, c).orderBy(F.col("n").desc(), "element").limit(examples)) for c in lists},
    }
