"""Joins on a mass axis: windows by ratio or difference, nested channels and fallbacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import places
from .places import finite


def ppm_error(observed: Column, expected: Column) -> Column:
    """1e6 (observed - expected) / expected; null where expected is zero."""
    return F.when(expected != 0, 1e6 * (observed - expected) / expected)


#: Rows of one mass that a list holds, about.
ALIKE = 1024
#: Tasks that pairs of lists are dealt to, at least.
DEALT = 200


def _listed(library: DataFrame, keys: list[str]) -> DataFrame:
    """keys and __alike: the other columns of the rows with equal keys in lists, dealt by a hash where there are over ALIKE. Rows with a null key go, as they match nothing."""
    rest = [c for c in library.columns if c not in keys]
    library = library.dropna(subset=keys)
    size = library.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.ceil(F.col("__n") / ALIKE).cast("long")
    rows = library.join(size.filter(F.col("__n") > ALIKE), keys, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*rest), parts), F.lit(0).cast("long")))
    return rows.groupBy(*keys, "__part").agg(F.collect_list(F.struct(*rest)).alias("__alike")).drop("__part")


def _window(queries: DataFrame, library: DataFrame, low: Column, high: Column, bucket, equal: str | None = None, lists: bool = True) -> DataFrame:
    """Equi-join on buckets of the axis (and on the column `equal`, which both have); the exact window stays as a residual. A library row has one bucket, so no pair repeats.

    The queries, which fall into one or two buckets, are the side that multiplies. Library rows of one mass go as a list (unless lists is false), which is compared once and taken apart
    behind the join. The join is an ordinary one: Spark broadcasts a side below its threshold, else merges, and splits hot buckets.
    """
    q = queries.filter(finite(F.col("mass"))).withColumnRenamed("mass", "query_mass")
    q = q.withColumn("__low", low).withColumn("__high", high)
    q = q.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__low")), bucket(F.col("__high")))))
    keys = ["mass", *([equal] if equal else [])]
    rest = [c for c in library.columns if c not in keys] if lists else []
    c = library.filter(finite(F.col("mass")) & (F.col("mass") > 0))
    c = (_listed(c, keys) if rest else c).withColumn("__bucket", bucket(F.col("mass")))
    pairs = q.join(c, ["__bucket", *keys[1:]]).filter(F.col("mass").between(F.col("__low"), F.col("__high"))).drop("__bucket", "__low", "__high")
    return _apart(pairs, "__alike", rest) if rest else pairs


def _apart(pairs: DataFrame, lists: str, names: list[str]) -> DataFrame:
    """A row for each element of the lists, whose fields `names` stand in its stead."""
    return pairs.withColumn(lists, F.explode(lists)).select(*[c for c in pairs.columns if c != lists], *[F.col(f"{lists}.`{c}`") for c in names])


def _alike_pairs(queries: DataFrame, library: DataFrame, keys: list[str], query_keys: list[str], pairs) -> DataFrame:
    """pairs(queries, library), which goes by query_keys and keys alone and may add columns: rows alike in these go as lists on either side and are compared once.

    What remains for a pair of rows is to be taken out of two lists. The pairs of lists, at most ALIKE by ALIKE rows each, about, are dealt by a hash before that, as a task's work is that of the rows it makes, not of the bytes it reads.
    """
    asked, held = ([c for c in df.columns if c not in on] for df, on in ((queries, query_keys), (library, keys)))
    if not asked or not held:
        return pairs(queries, library)
    # Lists of a single column are plain ones, which are smaller and quicker to take apart.
    named = lambda df, on, rest, name: df.select(*on, (F.col(f"__alike.`{rest[0]}`") if len(rest) == 1 else F.col("__alike")).alias(name))
    q, c = named(_listed(queries, query_keys), query_keys, asked, "__asked"), named(_listed(library, keys), keys, held, "__held")
    tasks = max(DEALT, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = pairs(q, c).repartition(tasks, F.xxhash64("__asked", "__held"))
    for lists, rest in (("__asked", asked), ("__held", held)):
        met = met.withColumn(lists, F.explode(lists)).withColumnRenamed(lists, rest[0]) if len(rest) == 1 else _apart(met, lists, rest)
    return met


def library_window(queries: DataFrame, library: DataFrame, ppm: float) -> DataFrame:
    """As mass_window, for masses of any sign: the half width is |query_mass| * ppm * 1e-6, ends included. Masses of one sign never meet the other's."""
    if ppm < 0:
        raise ValueError("ppm must not be negative")
    width = math.log1p(4e-6 * ppm) or 1e-9
    sided = lambda df: df.filter(finite(F.col("mass")) & (F.col("mass") != 0)).withColumn("__side", F.signum("mass")).withColumn("mass", F.abs("mass"))
    half = F.col("query_mass") * ppm * 1e-6
    q = sided(queries).withColumnRenamed("__side", "__query_side")
    pairs = _window(q, sided(library), F.col("query_mass") - half, F.col("query_mass") + half, lambda m: F.floor(F.log(m) / width))
    return pairs.filter("__side = __query_side").withColumn("mass", F.col("__side") * F.col("mass")).withColumn("query_mass", F.col("__side") * F.col("query_mass")).drop("__side", "__query_side")


def mass_window(queries: DataFrame, library: DataFrame, ppm: float, equal: str | None = None, lists: bool = True) -> DataFrame:
    """Pairs with mass in query_mass +- query_mass * ppm * 1e-6, ends included. queries: mass and other columns; library: mass > 0. equal: a column of both that must be equal. lists: as for _window."""
    if ppm < 0:
        raise ValueError("ppm must not be negative")
    width = math.log1p(4e-6 * ppm) or 1e-9
    at = lambda m: F.floor(F.log(m) / width)
    half = F.col("query_mass") * ppm * 1e-6
    return _window(queries.filter(F.col("mass") > 0), library, F.col("query_mass") - half, F.col("query_mass") + half, at, equal, lists)


def da_window(queries: DataFrame, library: DataFrame, da: float) -> DataFrame:
    """Pairs with mass in query_mass +- da, ends included; da = 0 leaves equal masses."""
    if da < 0:
        raise ValueError("da must not be negative")
    width = 2 * da or 1e-6
    at = lambda m: F.floor(m / width)
    return _window(queries, library, F.col("query_mass") - da, F.col("query_mass") + da, at)


def nearest_first(pairs: DataFrame, limit: int, query: str = "qid", tie: str = "cid") -> DataFrame:
    """The `limit` pairs of each query that are nearest in mass, numbered by mass_rank."""
    w = Window.partitionBy(query).orderBy(F.abs(F.col("mass") - F.col("query_mass")), tie)
    return pairs.withColumn("mass_rank", F.row_number().over(w)).filter(F.col("mass_rank") <= limit)


def nearest_in(queries: DataFrame, library: DataFrame, limit: int, pairs, query: str | None = "qid", tie: str = "cid") -> DataFrame:
    """nearest_first(pairs(queries, library), limit, query, tie), where pairs go by the masses alone; without query each row is one of its own.

    Pairs are made of the different masses of the queries with `limit` library rows of each mass at most, so rows that share a mass make no pairs until the nearest are known.
    """
    few = nearest_first(library.withColumn("query_mass", F.col("mass")), limit, "mass", tie).drop("query_mass", "mass_rank")
    best = nearest_first(pairs(queries.select("mass").distinct(), few), limit, "query_mass", tie)
    rows = queries.withColumnRenamed("mass", "query_mass")
    if query is None:
        return rows.join(best, "query_mass")
    return nearest_first(rows.join(best.drop("mass_rank"), "query_mass"), limit, query, tie)


def channels(queries: DataFrame, library: DataFrame, tolerances: list[float], limit: int | None = None, query: str = "qid", tie: str = "cid") -> DataFrame:
    """One join at the widest tolerance; each pair lists all the tolerances it satisfies, and the least. limit: of a query's pairs in all channels together only so many are kept, the nearest."""
    if not tolerances or min(tolerances) < 0:
        raise ValueError("tolerances must be given, and not negative")
    inside = F.filter(F.array(*[F.lit(float(t)) for t in sorted(tolerances)]), lambda t: F.abs(F.col("mass") - F.col("query_mass")) <= F.col("query_mass") * t * 1e-6)
    # The widest tolerance tells whether any holds. A filter on the list itself, which has a lambda, the optimiser may push below the join.
    widest = F.abs(F.col("mass") - F.col("query_mass")) <= F.col("query_mass") * float(max(tolerances)) * 1e-6
    found = lambda q, c, lists=True: mass_window(q, c, max(tolerances), lists=lists).filter(widest)
    told = lambda pairs: pairs.withColumn("tolerances", inside).withColumn("least_ppm", F.array_min("tolerances"))
    if limit is None:
        return _alike_pairs(queries, library, ["mass"], ["mass"], lambda q, c: told(found(q, c, False)))
    return told(nearest_in(queries, library, limit, found, query, tie).drop("mass_rank"))


def widened(queries: DataFrame, library: DataFrame, narrow: float, wide: float, query: str = "qid") -> DataFrame:
    """The narrow window's pairs; for queries without any, those of the wide one. fallback tells which: the different masses of the library tell it before pairs are made, so pairs needn't meet."""
    inside = F.abs(F.col("mass") - F.col("query_mass")) <= F.col("query_mass") * narrow * 1e-6
    most = max(narrow, wide)
    some = mass_window(queries.select(query, "mass"), library.select("mass").distinct(), most).groupBy(query).agg(F.max(inside).alias("__some"))
    pairs = mass_window(queries.join(some, query), library, most)
    return pairs.filter(inside | ~F.col("__some")).withColumn("fallback", ~F.col("__some")).drop("__some")


def _any(pairs: DataFrame, holds: Column, query: str) -> DataFrame:
    """pairs with `__some`: whether any pair of the query holds. The flag is combined at the map side and joined back, so a query's pairs need not meet."""
    some = pairs.groupBy(query).agg(F.max(F.coalesce(holds, F.lit(False))).alias("__some"))
    return pairs.join(some, query)


def nearest_positions(queries: DataFrame, library: DataFrame, k: int, size: int = places.BLOCK) -> DataFrame:
    """For each query the k library rows around its place in the order of (mass, cid), k // 2 before it, moved in at the ends. Queries without a finite mass have no place."""
    return places.nearest(queries, library, k, size)


def mass_and_formula(queries: DataFrame, library: DataFrame, ppm: float) -> DataFrame:
    """Pairs of equal formula in the mass window; both narrow the join. queries: mass, formula. Rows alike in both are compared once, on either side."""
    return _alike_pairs(queries, library, ["mass", "formula"], ["mass", "formula"], lambda q, c: mass_window(q, c, ppm, "formula", lists=False))


def formula_lookup(queries: DataFrame, library: DataFrame) -> DataFrame:
    """Equal formulas; null matches nothing."""
    return queries.join(library, "formula")


def formula_near(queries: DataFrame, library: DataFrame, low: Column, high: Column) -> DataFrame:
    """formula_lookup with mass from low to high, expressions of query_mass (queries: query_mass, formula; library: mass, formula): rows alike in both are compared once, on either side."""
    return _alike_pairs(queries, library, ["formula", "mass"], ["formula", "query_mass"], lambda q, c: formula_lookup(q, c).filter(F.col("mass").between(low, high)))


def polarity(mode: Column, adduct: Column) -> Column:
    """Ion mode in lower case, else the sign that ends the adduct, else unknown."""
    return F.coalesce(F.when(F.trim(mode) != "", F.lower(F.trim(mode))), F.when(adduct.endswith("+"), "positive").when(adduct.endswith("-"), "negative"), F.lit("unknown"))


def same_or_any(pairs: DataFrame, same: Column, query: str = "qid") -> DataFrame:
    """Of each query the pairs for which `same` holds; all its pairs where it holds for none. A comparison with null doesn't hold."""
    holds = F.coalesce(same, F.lit(False))
    return _any(pairs, holds, query).filter(holds | ~F.col("__some")).drop("__some")


def analogs_of(candidates: DataFrame, analogs: DataFrame, most: int = 100, query: str = "query") -> DataFrame:
    """Each candidate of a query with the query's `most` best analogs (similarity; key decides ties), numbered by analog_rank. A candidate without analogs stays, with nulls.

    The bound comes before the join, so a query's pairs grow with its candidates alone.
    """
    order = F.row_number().over(Window.partitionBy(query).orderBy(F.col("similarity").desc(), "analog"))
    best = analogs.withColumn("analog_rank", order).filter(F.col("analog_rank") <= most)
    return candidates.join(best, query, "left")


def reused(pairs: DataFrame, cache: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs that the cache has, with its columns; pairs that are still to be scored)."""
    return pairs.join(cache, on), pairs.join(cache, on, "left_anti")


def looked_up(keys: DataFrame, rows: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """The rows of the keys; keys without a row are passed over, or, if strict, an error that names some."""
    if strict and (absent := [r[0] for r in keys.join(rows, key, "left_anti").select(key).limit(5).collect()]):
        raise ValueError(f"unknown {key}: {absent}")
    return keys.join(rows, key)


def with_fold(rows: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """rows with the fold of their key; a key without a fold is an error."""
    return looked_up(rows, folds.select(key, "fold"), key, strict=True)


def excluded_structures(names: DataFrame, name: str = "key") -> DataFrame:
    """Names that may exclude a structure: 14 capitals or digits; others are no keys."""
    return names.filter(F.col(name).rlike("^[A-Z0-9]{14}$")).select(name).distinct()


def in_database(manifest: DataFrame, library: DataFrame, truth: str = "truth", key: str = "key") -> DataFrame:
    """manifest with `present`: whether the library has the truth."""
    known = library.select(F.col(key).alias(truth)).distinct().withColumn("present", F.lit(True))
    return manifest.join(known, truth, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def without(pairs: DataFrame, excluded: DataFrame, on: list[str]) -> DataFrame:
    """Pairs that are not excluded."""
    return pairs.join(excluded, on, "left_anti")


def updated(rows: DataFrame, repairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of repairs where those are not null."""
    fixed = repairs.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = rows.join(fixed, key, "left")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*[f"new_{c}" for c in columns])
