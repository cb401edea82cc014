"""Places: a library in the order of (mass, cid), so that a window of masses is a pair of places, and a draw from it is arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..store import settled

#: Rows of a block; blocks whose first masses the driver and the workers hold (8 MB), beyond which blocks get larger instead.
BLOCK, MOST_BLOCKS = 512, 1 << 20
#: Masses of a block that are compared one by one.
STEP = 64


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


@dataclass(frozen=True)
class Places:
    """rows: the library's columns, __place and __block (place div size); masses: __block, __masses (in order); lows: the first mass of each block."""

    rows: DataFrame
    masses: DataFrame
    lows: np.ndarray
    total: int
    size: int


def placed(library: DataFrame, size: int = BLOCK) -> Places:
    """The rows of library (mass, cid, any others) with a finite mass, sorted in ranges and written once. The driver gets a number for each range and each block."""
    ship(library.sparkSession)
    rows = library.withColumn("mass", F.col("mass").cast("double")).filter(finite(F.col("mass")))
    # The id of a row is its range and, behind 33 bits, its number in the range.
    rows = settled(rows.repartitionByRange("mass", "cid").sortWithinPartitions("mass", "cid").withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright("__i", 33).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    starts = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(max(counts, default=-1) + 1)])]).astype(int)
    total = int(starts[-1])
    size = max(1, size, -(-total // MOST_BLOCKS))
    start = F.element_at(F.array(*[F.lit(int(x)) for x in starts]), part + 1).cast("long")
    rows = rows.withColumn("__place", start + F.col("__i").bitwiseAND((1 << 33) - 1)).drop("__i").withColumn("__block", F.floor(F.col("__place") / size))
    masses = settled(rows.groupBy("__block").agg(F.array_sort(F.collect_list("mass")).alias("__masses")))
    lows = [r[1] for r in sorted(masses.select("__block", F.col("__masses")[0]).collect())] if total else []
    return Places(rows, masses, np.array(lows, float), total, size)


def coarser(places: Places, factor: int) -> Places:
    """The same places in blocks of `factor` times as many rows."""
    if factor <= 1 or not places.total:
        return places
    size = places.size * factor
    rows = places.rows.withColumn("__block", F.floor(F.col("__place") / size))
    parts = F.array_sort(F.collect_list(F.struct("__block", "__masses")))
    masses = settled(places.masses.groupBy(F.floor(F.col("__block") / factor).alias("__wide")).agg(F.flatten(F.transform(parts, lambda x: x["__masses"])).alias("__masses")).withColumnRenamed("__wide", "__block"))
    return Places(rows, masses, places.lows[::factor], places.total, size)


def counted(frame: DataFrame, places: Places, name: str, value: Column, inclusive: bool = False) -> DataFrame:
    """frame with `name`: how many masses of the library are smaller than value, or, inclusive, not larger: the block by binary search in the first masses, the rest inside it."""
    lows, side = places.lows, "right" if inclusive else "left"

    @F.pandas_udf("long")
    def block_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lows, x, side) - 1)

    v = F.col("__value")
    found = frame.withColumn("__value", value).withColumn("__at", block_of("__value")).join(places.masses.select(F.col("__block").alias("__at"), "__masses"), "__at", "left")
    smaller = lambda m: m <= v if inclusive else m < v
    # In two steps, as blocks are long: of every STEP-th mass those that are smaller, then those after the last of these.
    ahead = F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size("__masses") - 1, F.lit(0)), F.lit(STEP)), lambda i: smaller(F.col("__masses")[i])))
    start = F.greatest(ahead - 1, F.lit(0)) * STEP
    inside = start + F.size(F.filter(F.slice("__masses", start + 1, STEP), smaller))
    return found.withColumn(name, F.when(F.col("__at") < 0, F.lit(0)).otherwise(F.col("__at") * places.size + inside).cast("long")).drop("__value", "__at", "__masses")


def around(first: Column, places: Places, k: int) -> Column:
    """The first of the k places around the place `first`, k // 2 before it, moved in at the ends."""
    left = F.greatest(F.lit(0), first - max(1, k // 2))
    return F.greatest(F.lit(0), F.least(left + k, F.lit(places.total)) - k).cast("long")


def windows(queries: DataFrame, places: Places, half: Column, nearest: int = 0) -> DataFrame:
    """queries with __first and __n: the places of the masses in mass +- half, ends included; where there are none, those of the `nearest` rows by place. Queries without a finite mass or without a place go."""
    q = queries.filter(finite(F.col("mass")))
    q = counted(counted(q, places, "__first", F.col("mass") - half), places, "__end", F.col("mass") + half, inclusive=True)
    n = F.col("__end") - F.col("__first")
    if nearest:
        some = n > 0
        q = q.withColumn("__n", F.when(some, n).otherwise(F.lit(min(nearest, places.total)))).withColumn("__first", F.when(some, F.col("__first")).otherwise(around(F.col("__first"), places, nearest)))
    else:
        q = q.withColumn("__n", n)
    return q.drop("__end").filter("__n > 0")


def nearest(queries: DataFrame, library: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """For each query the k library rows around its place in the order of (mass, cid), k // 2 before it, moved in at the ends; its mass is query_mass. A query explodes to its k places, and a place is one row."""
    places = placed(library, size)
    q = counted(queries.withColumn("mass", F.col("mass").cast("double")).filter(finite(F.col("mass"))).withColumnRenamed("mass", "query_mass"), places, "__first", F.col("query_mass"))
    q = q.filter(F.lit(places.total > 0 and k > 0)).withColumn("__left", around(F.col("__first"), places, k))
    q = q.withColumn("__place", F.explode(F.sequence("__left", F.col("__left") + min(k, places.total) - 1))).drop("__first", "__left")
    return q.join(places.rows.drop("__block"), "__place").drop("__place")
