"""Aggregation of hits into candidate evidence, and pooling of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("max", "mean", "topk", "noisy_or", "logsumexp")


def clipped(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def aggregated(hits: DataFrame, group: list[str], method: str = "topk", k: int = 3, spectrum: str = "spectrum", score: str = "score") -> DataFrame:
    """evidence of each group by one of METHODS; noisy-or first takes each query spectrum's best hit."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    rows = hits.withColumn("s", clipped(F.col(score)))
    if method == "max":
        return rows.groupBy(*group).agg(F.max("s").alias("evidence"))
    if method == "mean":
        return rows.groupBy(*group).agg(F.avg("s").alias("evidence"))
    if method == "topk":
        # Ranking first bounds what a group collects.
        w = Window.partitionBy(*group).orderBy(F.col("s").desc())
        return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy(*group).agg(F.avg("s").alias("evidence"))
    if method == "noisy_or":
        best = rows.groupBy(*group, spectrum).agg(F.max("s").alias("s"))
        # A product by sums of logarithms combines on the map side; a certain hit makes it 1.
        log = F.when(F.col("s") < 1, F.log1p(-F.col("s")))
        return best.groupBy(*group).agg(F.when(F.max("s") >= 1, 1.0).otherwise(1 - F.exp(F.coalesce(F.sum(log), F.lit(0.0)))).alias("evidence"))
    # Scores lie between 0 and 1, so 1 is a safe shift and no second pass is needed.
    return rows.groupBy(*group).agg((F.lit(1.0) + F.log(F.sum(F.exp(F.col("s") - 1)))).alias("evidence"))


def richest(rows: DataFrame, group: list[str], richness: str, row_id: str) -> DataFrame:
    """Row of each group with most peaks; the lowest row_id wins ties, then the greatest row."""
    whole = F.struct(*[c for c in rows.columns if c not in group])
    best = F.max_by(whole, F.struct(F.col(richness), -F.col(row_id), whole))
    return rows.groupBy(*group).agg(best.alias("b")).select(*group, "b.*")


def mode(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most frequent value; the smallest wins ties. Counts are combined before anything meets."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), value)
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def pooled(predictions: DataFrame, group: str, vector: str, weighted: bool = False) -> DataFrame:
    """Mean probability of each bit; weighted: by mean |p - 0.5| * 2 of the prediction, or plainly where all weights are zero."""
    rows = predictions.withColumn("w", F.aggregate(F.transform(vector, lambda p: F.abs(p - 0.5) * 2), F.lit(0.0), lambda a, v: a + v) / F.size(vector) if weighted else F.lit(1.0))
    bits = rows.select(group, "w", F.posexplode(vector).alias("bit", "p"))
    mean = F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("p")) / F.sum("w")).otherwise(F.avg("p"))
    return bits.groupBy(group, "bit").agg(mean.alias("p"))


def support(hits: DataFrame, group: list[str], spectrum: str = "spectrum", library: str = "library", score: str = "score") -> DataFrame:
    """What goes along with the evidence of each group: best score, how many query and library spectra, the first library spectrum and that of the best score (the first of equals)."""
    return hits.groupBy(*group).agg(F.max(score).alias("max_score"), F.count_distinct(spectrum).alias("spectra"), F.count_distinct(library).alias("libraries"), F.min(library).alias("first_library"), F.max_by(library, F.struct(F.col(score), -F.col(library))).alias("best_library"))


def hit_support(hits: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """What the hits of a search say of each group: max and mean of the k highest direct cosines, max modified and neutral-loss cosines, query and library spectra, most matched peaks and
    explained intensity, least absolute ppm (null where no hit has one), and the library spectrum of the best score, the smallest of equals."""
    top = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("direct").desc(), "cid", "qid"))
    rows = hits.withColumn("__r", top)
    best = F.max_by("cid", F.struct(F.round("score", 9), -F.col("cid")))
    return rows.groupBy(*group).agg(
        F.max("direct").alias("max_direct"), F.avg(F.when(F.col("__r") <= k, F.col("direct"))).alias("top_direct"), F.max("modified").alias("max_modified"), F.max("loss").alias("max_loss"), F.count_distinct("qid").alias("spectra"),
        F.count_distinct("cid").alias("libraries"), F.max("matched").alias("matched"), F.max("explained").alias("explained"), F.min(F.abs("ppm")).alias("least_ppm"), best.alias("best"),
    )


def neutral_mass(spectra: DataFrame, group: str, mass: str = "mass", exact: str | None = None) -> DataFrame:
    """group and mass: the exact mass where a spectrum tells one (the smallest of several), else the median of the masses that are finite and positive; a group without any is an error that names some."""
    good = lambda c: F.when(~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))
    median = F.median(good(mass))
    found = spectra.groupBy(group).agg((F.coalesce(F.min(good(exact)), median) if exact else median).alias("mass"))
    if without := [r[0] for r in found.filter("mass IS NULL").select(group).limit(5).collect()]:
        raise ValueError(f"no usable mass: {without}")
    return found


def context(spectra: DataFrame, group: str, mass: str, adduct: str, positive: Column, energy: str | None = None) -> DataFrame:
    """What is known of a query from its spectra: median mass, how many spectra and different adducts, the share of positive ones, the mean of the finite energies (0 if there is none)."""
    more = []
    if energy:
        finite = F.when(~F.isnan(energy) & (F.abs(energy) < float("inf")), F.col(energy))
        more = [F.coalesce(F.avg(finite), F.lit(0.0)).alias("energy")]
    return spectra.groupBy(group).agg(F.median(mass).alias("mass"), F.count(F.lit(1)).alias("spectra"), F.count_distinct(adduct).alias("adducts"), F.avg(positive.cast("double")).alias("positive"), *more)
