"""Feature frames for rankers, and the models on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import joins
from .kernels import FRAGMENT_SCORES, tanimoto
from .ranking import percentile, percentile_from_zero, ranked, top_n, z_score

# The columns of a candidate frame, and the features of the rankers, in order.
REQUIRED = (
    "molecule_id", "inchikey14", "smiles", "source", "formula", "target", "rank", "mass_rank", "mass_error_ppm", "absolute_mass_error_ppm", "mass_score_20ppm",
    "within_20ppm", "within_50ppm", "within_1000ppm", "predicted_fingerprint_score", "candidate_exact_mass", "neutral_mass", "candidate_count",
    "query_spectrum_count", "query_adduct_count", "query_positive_fraction", "query_mean_collision_energy",
)
BASE_FEATURES = (
    "mass_rank", "reciprocal_mass_rank", "mass_rank_percentile", "mass_error_ppm", "absolute_mass_error_ppm", "log_absolute_mass_error_ppm", "mass_score_20ppm",
    "within_20ppm", "within_50ppm", "within_1000ppm", "predicted_fingerprint_score", "fingerprint_rank", "reciprocal_fingerprint_rank",
    "fingerprint_rank_percentile", "fingerprint_score_z", "wide_mass_rank", "wide_fingerprint_rank", "wide_mass_rank_percentile",
    "wide_fingerprint_rank_percentile", "wide_candidate_count", "candidate_exact_mass", "neutral_mass", "candidate_count", "query_spectrum_count",
    "query_adduct_count", "query_positive_fraction", "query_mean_collision_energy", "source_coconut", "source_pubchemlite", "source_chembl", "has_formula",
)
DESCRIPTOR_FEATURES = ("candidate_heteroatom_count", "candidate_ring_count", "candidate_aromatic_fraction", "candidate_logp")
FRAGMENT_FEATURES = ("fragment_scored", "fragment_theoretical_count", *(f"fragment_{n}_{how}" for n in FRAGMENT_SCORES for how in ("max", "mean")))
RANKING_FEATURES = (*BASE_FEATURES, *DESCRIPTOR_FEATURES, *FRAGMENT_FEATURES)
ANALOG_FEATURES = ("analog_score_power4", "analog_score_linear", "analog_tanimoto_max", "analog_tanimoto_top", "analog_tanimoto_weighted_mean", "analog_top_similarity")
ANALOG_RANKING_FEATURES = (*ANALOG_FEATURES, "analog_rank", "reciprocal_analog_rank", "analog_rank_percentile", "analog_score_max", "analog_score_delta_max", "analog_score_z")
LABELS = ("target", "smiles", "canonical_smiles", "inchikey14", "formula")


def clean(c: Column) -> Column:
    """0 for what is null or not finite."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c.cast("double"))


def missing(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> None:
    if lacking := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"columns are missing: {lacking}")


def duplicates(rows: DataFrame, on: tuple[str, ...] = ("molecule_id", "inchikey14")) -> DataFrame:
    """Repeated pairs, which a feature frame may not have."""
    return rows.groupBy(*on).count().filter("count > 1")


def faults(rows: DataFrame, query: str = "molecule_id", key: str = "inchikey14") -> DataFrame:
    """fault, n: pairs of query and key that repeat, targets other than 0 and 1, queries with several positives; no row if the frame is sound."""
    bad = ~F.coalesce(F.col("target").isin(0, 1), F.lit(False))
    pair = rows.groupBy(query, key).agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("bad"), F.sum("target").alias("positives"))
    of = pair.groupBy(query).agg(F.sum((F.col("n") > 1).cast("long")).alias("repeated"), F.sum("bad").alias("target"), (F.sum("positives") > 1).cast("long").alias("positives"))
    sums = of.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("repeated", "target", "positives")])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(c).alias("n")) for c in sums.columns]))
    return sums.select(parts.alias("x")).select("x.*").filter("n > 0")


def checked(rows: DataFrame) -> DataFrame:
    """rows, if they have all columns of a candidate frame and no fault; else an error that names what is wrong."""
    missing(rows)
    if found := {r.fault: r.n for r in faults(rows).collect()}:
        raise ValueError(f"candidate rows are at fault: {found}")
    return rows


def ranking_features(rows: DataFrame, descriptors: DataFrame | None = None) -> DataFrame:
    """rows with the 49 RANKING_FEATURES; every feature finite. descriptors: one row of DESCRIPTOR_FEATURES for each inchikey14.

    Wide ranks and counts are the plain ones where rows lack them; descriptors and fragment scores that are given neither way are 0.
    """
    missing(rows)
    have = set(rows.columns)
    if descriptors is not None:
        missing(descriptors, ("inchikey14", *DESCRIPTOR_FEATURES))
        rows = rows.drop(*DESCRIPTOR_FEATURES).join(descriptors.select("inchikey14", *DESCRIPTOR_FEATURES).dropDuplicates(["inchikey14"]), "inchikey14", "left")
        have |= set(DESCRIPTOR_FEATURES)
    given = lambda c, other: F.col(c if c in have else other)
    rank, mass_rank, n = F.col("rank"), F.col("mass_rank"), F.col("candidate_count")
    wide_mass, wide_rank, wide_n = given("wide_mass_rank", "mass_rank"), given("wide_fingerprint_rank", "rank"), given("wide_candidate_count", "candidate_count")
    source = F.lower(F.coalesce("source", F.lit("")))
    new = {
        "fingerprint_rank": rank, "wide_mass_rank": wide_mass, "wide_fingerprint_rank": wide_rank, "wide_candidate_count": wide_n,
        "reciprocal_mass_rank": 1.0 / mass_rank, "reciprocal_fingerprint_rank": 1.0 / rank,
        "mass_rank_percentile": percentile(mass_rank, n), "fingerprint_rank_percentile": percentile(rank, n),
        "wide_mass_rank_percentile": percentile(wide_mass, wide_n), "wide_fingerprint_rank_percentile": percentile(wide_rank, wide_n),
        "log_absolute_mass_error_ppm": F.log1p("absolute_mass_error_ppm"), "fingerprint_score_z": z_score("predicted_fingerprint_score", ["molecule_id"]),
        "source_coconut": source.contains("coconut").cast("int"), "source_pubchemlite": source.contains("pubchem").cast("int"), "source_chembl": source.contains("chembl").cast("int"),
        "has_formula": F.col("formula").isNotNull().cast("int"),
    }
    value = lambda c: new[c] if c in new else F.col(c) if c in have else F.lit(0.0)
    return rows.select(*[c for c in rows.columns if c not in RANKING_FEATURES], *[clean(value(c)).alias(c) for c in RANKING_FEATURES])


def analog_evidence(candidates: DataFrame, analogs: DataFrame, power: float = 4.0, most: int = 100) -> DataFrame:
    """query, key and the six ANALOG_FEATURES. candidates: query, key, words; analogs: query, analog, similarity, analog_words; words as of kernels.packed.

    Similarities below 0 count as 0. Of a query's analogs the `most` best are looked at, before they meet its candidates; a candidate without analogs has zeros.
    """
    pairs = joins.analogs_of(candidates, analogs.withColumn("similarity", F.greatest(F.lit(0.0), F.col("similarity"))), most)
    t, s = F.col("t"), F.col("similarity")
    weight = F.pow(s, F.lit(power))
    best = F.min_by(F.struct(t.alias("t"), s.alias("s")), F.col("analog_rank"))
    values = (F.max(t * weight), F.max(t * s), F.max(t), best["t"], F.when(F.sum(weight) > 0, F.sum(t * weight) / F.sum(weight)), best["s"])
    rows = pairs.withColumn("t", F.when(F.col("analog_rank").isNotNull(), tanimoto(F.col("words"), F.col("analog_words"))))
    return rows.groupBy("query", "key").agg(*[F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(values, ANALOG_FEATURES, strict=True)])


def propagated(candidates: DataFrame, analogs: DataFrame, ppm: float = 20.0, most: int = 25) -> DataFrame:
    """query, key, mass_score, analog_score, analog_tanimoto, best_analog, final_score, final_rank of the candidates of a mass window.

    candidates: query, key, words, ppm (the mass error); analogs: query, analog, similarity, analog_words, of which each key counts once, by its best
    similarity. The score of an analog is its similarity times its Tanimoto similarity with the candidate; the final score is 0.85 of the best such
    and 0.15 of exp(-|ppm| / tolerance). Where no analog scores above 0 there is no best one.
    """
    once = analogs.groupBy("query", "analog").agg(F.max(F.struct("similarity", "analog_words")).alias("b")).select("query", "analog", "b.similarity", "b.analog_words")
    pairs = joins.analogs_of(candidates, once, most)
    t = F.when(F.col("analog_rank").isNotNull(), tanimoto(F.col("words"), F.col("analog_words")))
    pairs = pairs.withColumn("t", t).withColumn("s", F.col("similarity") * F.col("t"))
    best = F.max(F.when(F.col("s") > 0, F.struct("s", (-F.col("analog_rank")).alias("r"), "t", "analog")))
    mass = F.exp(-F.abs(F.first("ppm")) / max(ppm, 1e-12))
    rows = pairs.groupBy("query", "key").agg(best.alias("b"), mass.alias("mass_score"))
    rows = rows.select("query", "key", "mass_score", F.coalesce("b.s", F.lit(0.0)).alias("analog_score"), F.coalesce("b.t", F.lit(0.0)).alias("analog_tanimoto"), F.col("b.analog").alias("best_analog"))
    rows = rows.withColumn("final_score", 0.85 * F.col("analog_score") + 0.15 * F.col("mass_score"))
    return ranked(rows, ["query"], F.round("final_score", 12).desc(), F.col("key"), name="final_rank")


def by_expected_tanimoto(rows: DataFrame, n: int = 100) -> DataFrame:
    """The n candidates of each query whose bits (array<int>) agree best with its bit probabilities p: query, key, similarity, similarity_rank."""
    from .kernels import compatibility

    scored = rows.select("query", "key", compatibility(F.col("p"), F.col("bits"))["expected_tanimoto"].alias("similarity"))
    return top_n(scored, ["query"], n, F.round("similarity", 12).desc(), F.col("key")).withColumnRenamed("top_rank", "similarity_rank")


#: Queries and candidates that a task compares at once.
COMPARED = (1024, 4096)


def nearest_by_expected_tanimoto(queries: DataFrame, candidates: DataFrame, n: int = 100, group: str = "group") -> DataFrame:
    """by_expected_tanimoto of the pairs with an equal `group`, which never are rows: parts of a group's queries (query, p) meet parts of its candidates (key, bits), and of each the n best go on.

    All pairs are compared, in products of matrices of at most about COMPARED. p and bits have one length and no nulls; rows without a group have no pair.
    """
    ship(queries.sparkSession)
    parts = lambda rows, most, name: rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    of = parts(queries, COMPARED[0], "__m").join(parts(candidates, COMPARED[1], "__k"), group)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = queries.join(of, group).select(F.col(group).alias("__g"), one("query", "__m").alias("__q"), every("__k").alias("__c"), "query", F.col("p").cast("array<double>").alias("p"))
    right = candidates.join(of, group).select(F.col(group).alias("__g"), every("__m").alias("__q"), one("key", "__k").alias("__c"), "key", F.col("bits").cast("array<double>").alias("bits"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c, rows in (("query", queries), ("key", candidates))) + ", similarity double"

    def matrix(rows: pa.Table, name: str) -> np.ndarray:
        return rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

    def work(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"query": q["query"].slice(0, 0), "key": c["key"].slice(0, 0), "similarity": pa.array([], pa.float64())})
        c = c.sort_by("key")
        p, b = matrix(q, "p"), matrix(c, "bits")
        inter = p @ b.T
        either = p.sum(axis=1)[:, None] + b.sum(axis=1) - inter
        similarity = np.divide(inter, either, out=np.ones_like(inter), where=either > 0)
        # Candidates are in the order of their keys, so a stable sort leaves equal ones in it.
        best = np.argsort(-np.round(similarity, 12), axis=1, kind="stable")[:, :n]
        at = np.repeat(np.arange(len(p)), best.shape[1])
        return pa.table({"query": q["query"].combine_chunks().take(pa.array(at)), "key": c["key"].combine_chunks().take(pa.array(best.ravel())), "similarity": pa.array(similarity[at, best.ravel()])})

    keys = ("__g", "__q", "__c")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)
    return top_n(best, ["query"], n, F.round("similarity", 12).desc(), F.col("key")).withColumnRenamed("top_rank", "similarity_rank")


def fragment_features(scores: DataFrame, group: list[str], most: int = 8, order: str = "spectrum") -> DataFrame:
    """group and the 14 FRAGMENT_FEATURES: maximum and mean of each score over the first `most` spectra by `order`. scores: group, spectrum (or another order), theoretical (how many masses), and FRAGMENT_SCORES."""
    kept = top_n(scores, group, most, F.col(order))
    some = F.max("theoretical") > 0
    values = [F.lit(1.0), F.max("theoretical").cast("double"), *(f(n) for n in FRAGMENT_SCORES for f in (F.max, F.avg))]
    return kept.groupBy(*group).agg(*[F.when(some, v).otherwise(0.0).alias(c) for v, c in zip(values, FRAGMENT_FEATURES, strict=True)])


def analog_features(rows: DataFrame, ties: str = "rank") -> DataFrame:
    """rows (molecule_id, rank, ANALOG_FEATURES) with the 12 ANALOG_RANKING_FEATURES: rank, percentile from zero, z-score, and distance from a query's best; all finite. Ties keep the order of rank, or of another column."""
    missing(rows, ("molecule_id", ties, *ANALOG_FEATURES))
    w = Window.partitionBy("molecule_id")
    score = "analog_score_power4"
    rows = ranked(rows, ["molecule_id"], F.col(score).desc(), F.col(ties), name="analog_rank")
    r, top = F.col("analog_rank"), F.max(score).over(w)
    new = {
        "reciprocal_analog_rank": 1.0 / r, "analog_rank_percentile": percentile_from_zero(r, F.count(F.lit(1)).over(w)), "analog_score_max": top,
        "analog_score_delta_max": F.col(score) - top, "analog_score_z": z_score(score, ["molecule_id"]),
    }
    return rows.select(*[c for c in rows.columns if c not in ANALOG_RANKING_FEATURES], *[clean(new.get(c, F.col(c))).alias(c) for c in ANALOG_RANKING_FEATURES])


def unlabelled(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """rows with their labels null, so that a query can't leak its answer; the schema stays."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in labels if c in rows.columns})


def binned_label(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the bin of a value: below the first edge, from each edge up to the next, from the last on."""
    out = F.lit(names[-1])
    for edge, name in zip(reversed(edges), reversed(names[:-1]), strict=True):
        out = F.when(value < edge, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def mass_bin(mass: Column) -> Column:
    return binned_label(mass, [250, 350, 500], ["<250", "250-350", "350-500", ">=500"])


def count_bin(n: Column) -> Column:
    return binned_label(n, [2, 4, 11], ["1", "2-3", "4-10", "11+"])


def isotopic(smiles: Column) -> Column:
    """Whether a structure names an isotope: a number before an element in brackets."""
    return smiles.rlike(r"\[\d+[A-Z]")


def selected(rows: DataFrame, columns: list[str]) -> DataFrame:
    missing(rows, tuple(columns))
    return rows.select(*columns)


def bounded(rows: DataFrame, n: int = 50, query: str = "query", key: str = "key") -> DataFrame:
    """The n candidates of each query that are best in either ranking."""
    return top_n(rows, [query], n, F.least("mass_rank", "rank"), F.col("mass_rank"), F.col(key)).drop("top_rank")


def merged(rows: DataFrame, features: DataFrame, prefix: str, on: list[str]) -> DataFrame:
    """Left join of features under a prefix; absent ones are 0, columns that both have stay the left one's."""
    extra = [c for c in features.columns if c not in on and f"{prefix}{c}" not in rows.columns]
    return rows.join(features.select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in extra]), on, "left").fillna(0, [f"{prefix}{c}" for c in extra])


def blend_grid(rows: DataFrame, manifest: DataFrame, steps: int = 21, k: int = 25) -> DataFrame:
    """weight, mrr of blending mass_score with score, for weights 0 to 1; ties between weights go to the larger by the caller's order.

    Only the truth's rank is needed: how many of a query's candidates blend higher. One aggregate for all weights.
    """
    true = rows.join(manifest, "query").filter(F.col("key") == F.col("truth")).select("query", F.col("mass_score").alias("tm"), F.col("score").alias("ts"), F.col("key").alias("tk"))
    pairs = rows.join(true, "query")
    weights = [i / (steps - 1) for i in range(steps)]
    mix = lambda w, a, b: w * F.col(a) + (1 - w) * F.col(b)
    above = [F.sum(((mix(w, "mass_score", "score") > mix(w, "tm", "ts")) | ((mix(w, "mass_score", "score") == mix(w, "tm", "ts")) & (F.col("key") < F.col("tk")))).cast("long")).alias(f"a{i}") for i, w in enumerate(weights)]
    ranks = manifest.join(pairs.groupBy("query").agg(*above), "query", "left")
    wide = ranks.agg(*[F.avg(F.when(F.col(f"a{i}") < k, 1.0 / (F.col(f"a{i}") + 1)).otherwise(0.0)).alias(f"m{i}") for i in range(steps)])
    parts = F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"m{i}").alias("mrr")) for i, w in enumerate(weights)]))
    return wide.select(parts.alias("x")).select("x.*")


def best_weight(grid: DataFrame) -> DataFrame:
    """The row of blend_grid with the highest mrr (in nine digits); of equal ones that of the largest weight."""
    return grid.orderBy(F.round("mrr", 9).desc(), F.col("weight").desc()).limit(1)


def pointwise_ranker(train: DataFrame, features: list[str], target: str = "target", trees: int = 20, depth: int = 4):
    """Boosted trees on single candidates. A labelled substitute: the reference's list-wise LambdaRank has no counterpart in Spark's library."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    steps = [VectorAssembler(inputCols=features, outputCol="features"), GBTRegressor(labelCol=target, featuresCol="features", predictionCol="ranker_score", maxIter=trees, maxDepth=depth, seed=1)]
    return Pipeline(stages=steps).fit(train)
