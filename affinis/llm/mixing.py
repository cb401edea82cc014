"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import passing, scratch, settled

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a bin of sampling keys holds; bins of a source are summed apart, then laid end to end.
BIN_ROWS = 4000


def words(text: str = "text") -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Share of letters, digits and spaces among the characters, at least 1/20: junk full of symbols comes later in the partial epoch."""
    n = F.length(text)
    junk = n - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.when(n > 0, 1 - junk / n), F.lit(0.05)))


def targets(sizes: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of one row per source (source, source_size).

    Weights repeat over the sources in order (null last). A target is the weight times a common level, or `most` times the
    source's size where that is less; the level is the one at which all targets add up to share of all sizes. With the
    sources in order of size per weight the capped ones come first, so prefix sums give it without iterating.
    These windows hold a row for each source, not for each document.
    """
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(pattern) + 1
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), at.cast("int"))).withColumn("cap", F.lit(most) * F.col("source_size"))
    everyone = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("goal", F.lit(share) * F.sum("source_size").over(everyone)).withColumn("open_w", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / F.col("open_w"))
    # The level that the first uncapped source finds is the one that holds; if all are capped, none is needed.
    rows = rows.withColumn("held", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everyone)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("held") * F.col("w")), F.col("cap")).alias("target"))


#: Classes of weights, by which the spread of a source's keys is known.
CLASSES = 20


def _bin(key: Column, counts: Column, n: Column, bins: Column) -> Column:
    """Place of a key among `bins` bins that hold about as many rows each, whatever the weights.

    Of rows of weight w a share of 1 - exp(-w k) has a key below k; counts tells how many rows each class of weights has. The
    share of all rows so found grows with the key, so bins follow the order of keys; it is off only by the width of a class.
    """
    below = F.aggregate(F.zip_with(counts, F.sequence(F.lit(1), F.lit(CLASSES)), lambda c, i: c * (1 - F.exp(-key * (i - 0.5) / CLASSES))), F.lit(0.0), lambda a, v: a + v)
    return F.least(bins - 1, F.floor(below / n * bins)).cast("long")


def mix(rows: DataFrame, seed: str = "mix", bin_rows: int = BIN_ROWS) -> DataFrame:
    """source, source_size, target, epochs, part, taken added to rows (doc_id, source, size, weight in (0, 1], name).

    Every document is taken in as many complete epochs as its source's target holds; the rest of the target is filled in
    order of the exponential keys -ln(u) / weight, u hashed from the name (the id, or what stands for a null one), so reruns agree: part is
    what that takes of the document's words, the last one's share being cut to the budget. taken = epochs * size + part.
    Sources are never sorted whole: keys fall into bins of about bin_rows rows, whose sums are laid end to end, and only bins are sorted.
    A null source is a source of its own, ties fall by id; a source without words takes nothing.
    """
    u = (F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.col("name")), "utf-8")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = rows.withColumn("key", -F.log(u) / F.col("weight"))
    in_class = F.least(F.lit(CLASSES - 1), F.floor(F.col("weight") * CLASSES).cast("int"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.array(*[F.count(F.when(in_class == i, 1)).cast("double") for i in range(CLASSES)]).alias("counts"))
    goal = targets(sizes).join(sizes.select(F.col("source").alias("s2"), "n", "counts"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("n") / bin_rows)).cast("long"))
    goal = settled(goal.select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget", "bins", "n", "counts"))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("bin", _bin(F.col("key"), F.col("counts"), F.col("n"), F.col("bins"))).drop("counts", "n")
    bins = rows.groupBy("s", "bin").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("s").alias("s3"), F.col("bin").alias("bin3"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(bins, F.col("s").eqNullSafe(F.col("s3")) & (F.col("bin") == F.col("bin3")))
    part = F.least("size", F.greatest(F.lit(0), F.col("budget") - F.col("base") - F.col("run")))
    rows = rows.withColumn("part", part.cast("long")).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
    return rows.drop("key", "name", "s", "bins", "bin", "run", "s3", "bin3", "base", "budget")


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    id_ = F.col("doc_id").cast("long")
    # Null ids would all share one key, so their texts name them.
    name = F.coalesce(id_.cast("string"), F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    return docs.select(id_.alias("doc_id"), "source", words().alias("size"), quality_weight().alias("weight"), name.alias("name"), *more)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    Null and empty texts have no words and take nothing; a very long text is one row like any other, and the one that the budget
    ends in is cut; an empty table gives no rows; other columns are left aside.
    """
    return mix(settled(_rows(docs))).select("doc_id", "size", "source_size", "target", "taken")


def repeated_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them: once for each complete epoch, and once more where over half of the document falls into the partial one.

    Rows alike in id, text and source are told apart by nothing the mix sees: each comes as often as all of them do on average, rounded
    down, and one of them stands for the rest. Columns of docs may have any names.
    """
    spark = docs.sparkSession
    # What the rows come from goes at once; the result reads the times alone, whenever it is read.
    with passing(spark) as keep:
        times = mix(settled(_rows(docs, F.xxhash64("text").alias("h")))).select("doc_id", "h", "source", (F.col("epochs") + F.when(F.col("part") * 2 > F.col("size"), 1).otherwise(0)).alias("times"))
        times = times.groupBy("doc_id", "h", "source").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("rows")).filter("total > 0")
        keep.append(scratch(spark))
        times = settled(times.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), F.col("source").alias("s"), F.floor(F.col("total") / F.col("rows")).cast("int").alias("each"), (F.col("total") % F.col("rows")).cast("int").alias("rest")), path=keep[0])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "source")
    match = keyed["doc_id"].eqNullSafe(F.col("i")) & (keyed["h"] == F.col("g")) & keyed["source"].eqNullSafe(F.col("s"))
    out = keyed.join(times.filter("each > 0"), match).select("row", F.explode(F.sequence(F.lit(1), F.col("each"))))
    rest = times.filter("rest > 0")
    if not rest.isEmpty():
        one = keyed.join(rest, match).dropDuplicates(["doc_id", "h", "source"])
        out = out.unionByName(one.select("row", F.explode(F.sequence(F.lit(1), F.col("rest")))))
    return out.select("row.*")
