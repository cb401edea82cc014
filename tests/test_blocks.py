"""Places and the search in blocks against plain computations over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import blocks, joins, matching, places, ranking, retrieval

PEAKS = "array<struct<mz: double, intensity: double>>"
LIBRARY = f"cid long, key long, mass double, mode string, peaks {PEAKS}, n int, place int, low double, high double, bucket int, at int, first int"
QUERIES = f"qid long, mass double, mode string, peaks {PEAKS}, n int, place int, low double, high double, bucket int, at int, first int"
CLASH = (1, 2, 3.0, 4.0, 5, 6, 7)


def spectrum(r):
    """Peaks on a coarse grid, so that several match, products tie and masses repeat."""
    return [(float(r.randrange(40)), float(r.randrange(1, 4))) for _ in range(r.randrange(7))]


def spectra(seed, n, first=0):
    r = random.Random(seed)
    return [(first + i, r.randrange(9), float(r.choice((30, 30, 30, 31.5, 40, 41, 55, 90))), r.choice(("+", "-", None)), spectrum(r)) for i in range(n)]


@pytest.fixture
def sides(spark):
    lib = [*spectra(1, 90), (90, 1, 33.0, "+", None), (91, 1, 33.0, "+", []), (92, 1, 33.0, "+", [(3.0, None), (None, 1.0), (5.0, 2.0)]), (93, 2, None, "+", [(1.0, 1.0)]), (94, 2, float("nan"), "+", [(1.0, 1.0)]), (95, 2, float("inf"), "+", [])]
    ask = [(i, m, k, p) for i, _, m, k, p in [*spectra(1, 30), *spectra(2, 40, 500)]] + [(900, None, "+", [(1.0, 1.0)]), (901, 33.0, "-", None), (902, 1e6, "+", spectrum(random.Random(1))), (903, -5.0, None, [(3.0, 1.0)])]
    return spark.createDataFrame([(*x, *CLASH) for x in ask], QUERIES), spark.createDataFrame([(*x, *CLASH) for x in lib], LIBRARY)


def plain(queries, library, near, most=None, tolerance=1.0):
    """All pairs for which near holds, scored as rows; (qid, cid) -> scores."""
    q = queries.select("qid", F.col("mass").alias("query_mass"), F.col("peaks").alias("q"), F.coalesce("mode", F.lit("unknown")).alias("q_mode"))
    pairs = q.crossJoin(library.select("cid", "mass", "mode", "peaks")).filter(joins.finite(F.col("query_mass")) & joins.finite(F.col("mass"))).filter(near)
    if most:
        pairs = ranking.systematic(pairs, most, ["qid"], F.col("mass"), F.col("cid"))
    same = (F.coalesce("mode", F.lit("unknown")) == F.col("q_mode")).alias("same")
    return {(r.qid, r.cid): r for r in matching.with_cosines(pairs.filter("qid <> cid").select("qid", "cid", "query_mass", "mass", same, "q", "peaks"), tolerance).collect()}


@pytest.mark.parametrize(("size", "most", "top"), [(512, None, 1000), (7, None, 1000), (7, 5, 1000), (7, 1, 1000), (3, 200, 4)])
def test_blocks_score_as_pairs_do(spark, sides, monkeypatch, size, most, top):
    queries, library = sides
    monkeypatch.setattr(blocks, "QUERIES", 4)
    monkeypatch.setattr(blocks, "HELD", 50)
    want = plain(queries, library, F.abs(F.col("mass") - F.col("query_mass")) <= 10.0, most)
    p = places.placed(library, size)
    got = blocks.hits(queries.drop("n"), p, F.lit(10.0), 1.0, top, most=most).collect()
    assert len(got) == len({(r.qid, r.cid) for r in got})
    some = {}
    for (q, _), r in want.items():
        some[q] = some.get(q, False) or r.same
    if top == 1000:
        # Blocks without the same polarity also give the others.
        assert {k for k, r in want.items() if r.same or not some[k[0]]} <= {(r.qid, r.cid) for r in got} <= set(want)
    for r in got:
        w = want[r.qid, r.cid]
        assert (r.same, r.matched) == (w.same, w.matched) and all(abs(r[c] - w[c]) < 1e-12 for c in ("direct", "explained", "modified", "loss")), (r, w)
        assert r.q_place == 2 and r.n == 1 and r.query_mass == w.query_mass and r.mass == w.mass
    found = retrieval.search(queries, p, da=10.0, tolerance=1.0, most=most, top_n=top).collect()
    score = lambda r: round(0.6 * r.direct + 0.25 * r.modified + 0.15 * r.loss, 9)
    best = {}
    for (q, c), r in want.items():
        if r.same or not some[q]:
            best.setdefault(q, []).append((-score(r), c))
    assert sorted((r.qid, r.cid) for r in found) == sorted((q, c) for q, x in best.items() for _, c in sorted(x)[:top])


def test_ppm_between_peaks_and_columns_of_hits(spark):
    lib = spark.createDataFrame([(1, 1, 200.0, "+", [(100.0, 1.0), (150.0, 2.0)], "[M+H]+", 10.0), (2, 1, 200.001, "+", [(100.004, 1.0)], None, None)], f"cid long, key long, mass double, mode string, peaks {PEAKS}, adduct string, energy double")
    q = spark.createDataFrame([(9, "x", 200.0, "+", [(100.002, 1.0)], "[M+H]+", 30.0)], f"qid long, query string, mass double, mode string, peaks {PEAKS}, adduct string, energy double")
    hits = {r.cid: r for r in retrieval.search(q, lib, ppm=20.0, tolerance=25.0, unit="ppm").collect()}
    assert (hits[1].matched, hits[2].matched) == (1, 1) and hits[1].same_adduct and not hits[2].same_adduct and hits[1].energy_difference == 20.0 and hits[2].energy_difference is None
    assert hits[1].mass_delta == 0 and abs(hits[2].ppm + 5) < 1e-3 and hits[1].query == "x"
    assert {r.cid: r.matched for r in retrieval.search(q, lib, ppm=20.0, tolerance=15.0, unit="ppm").collect()} == {1: 0, 2: 0}
    with pytest.raises(ValueError, match="unit"):
        retrieval.search(q, lib, unit="mDa")


def test_nothing_to_search(spark, sides):
    queries, library = sides
    assert retrieval.search(queries, library.limit(0), ppm=20.0).count() == 0
    assert retrieval.search(queries.limit(0), library, ppm=20.0).count() == 0


def test_predict_wants_one_query_for_each_spectrum(spark):
    lib = spark.createDataFrame([(1, 1, 100.0, "+", [(5.0, 1.0)])], f"cid long, key long, mass double, mode string, peaks {PEAKS}")
    of = lambda *ids: spark.createDataFrame([(i, q, 100.0, "+", [(5.0, 1.0)]) for i, q in ids], f"qid long, query string, mass double, mode string, peaks {PEAKS}")
    assert [(r.query, r.key, r["rank"]) for r in retrieval.predict(of((7, "a"), (8, "a")), lib).collect()] == [("a", 1, 1)]
    for wrong in (of((7, None)), of((7, "a"), (7, "b")), of((None, "a"))):
        with pytest.raises(ValueError, match="one query"):
            retrieval.predict(wrong, lib)


@pytest.mark.parametrize("size", [1, 4, 512])
def test_counts_below_values(spark, size):
    r = random.Random(6)
    masses = [float(r.choice((0, 1, 1, 1, 2, 7, -3))) for _ in range(50)]
    p = places.placed(spark.createDataFrame([(i, m) for i, m in enumerate(masses)], "cid int, mass double").repartition(5), size)
    assert p.total == 50 and [(x.mass, x.cid) for x in p.rows.orderBy("__place").collect()] == sorted((m, i) for i, m in enumerate(masses))
    values = spark.createDataFrame([(float(v),) for v in (-9, -3, 0, 0.5, 1, 2, 6.9, 7, 8)], "v double")
    got = places.counted(places.counted(values, p, "below", F.col("v")), p, "upto", F.col("v"), inclusive=True).collect()
    assert all((x.below, x.upto) == (sum(m < x.v for m in masses), sum(m <= x.v for m in masses)) for x in got) and len(got) == 9


def test_counts_go_in_two_steps(spark, monkeypatch):
    """Inside a block only every STEP-th mass and those of one step are compared."""
    monkeypatch.setattr(places, "STEP", 4)
    masses = sorted(float(i // 3) for i in range(100))
    p = places.placed(spark.createDataFrame([(i, m) for i, m in enumerate(masses)], "cid int, mass double"), 30)
    values = spark.createDataFrame([(v / 2,) for v in range(-3, 75)], "v double")
    got = places.counted(places.counted(values, p, "below", F.col("v")), p, "upto", F.col("v"), inclusive=True)
    assert all((r.below, r.upto) == (sum(m < r.v for m in masses), sum(m <= r.v for m in masses)) for r in got.collect())


def test_no_pair_is_a_row_with_a_spectrum(spark, sides):
    """The plan of a search: no window and no sort over pairs with spectra, one meeting of blocks and queries."""
    queries, library = sides
    plan = retrieval.search(queries, library, da=10.0, tolerance=1.0, most=5)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert "peaks" not in above and plan.count("FlatMapCoGroupsInArrow") >= 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_columns_of_the_caller_stay(spark, sides):
    """Frames that have n, place, low, high, bucket, at and first keep them through windows, neighbours and draws."""
    queries, library = sides
    q, lib = queries.select("qid", "mass", "n", "place"), library.select("cid", "mass", "low", "high", "bucket", "at", "first")
    kept = {"n": 1, "place": 2, "low": 3.0, "high": 4.0, "bucket": 5, "at": 6, "first": 7}
    for found in (joins.da_window(q, lib, 5.0), joins.library_window(q, lib, 1e5), joins.mass_window(q.filter("mass > 0"), lib, 1e5), joins.widened(q, lib, 10.0, 1e5), joins.nearest_positions(q, lib, 3)):
        row = found.first()
        assert {c: row[c] for c in kept} == kept and not [c for c in found.columns if c.startswith("__")]
    for k, places_ in ((1, [0]), (2, [0, 9]), (3, [0, 4, 9]), (20, list(range(10)))):
        rows = spark.range(10).selectExpr("id", "1 AS g", "7 AS n", "8 AS place")
        got = ranking.systematic(rows, k, ["g"], F.col("id")).collect()
        assert sorted(r.id for r in got) == places_ and all((r.n, r.place) == (7, 8) for r in got)


def test_masses_of_queries(spark):
    from affinis.operators import evidence

    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("a", nan, nan), ("b", 5.0, 9.5), ("b", 7.0, 9.0), ("c", -1.0, 2.0)], "query string, mass double, exact double")
    assert dict(map(tuple, evidence.neutral_mass(rows, "query", exact="exact").collect())) == {"a": 2.0, "b": 9.0, "c": 2.0}
    for bad in ([("x", None, None)], [("x", nan, inf)], [("x", -3.0, 0.0)]):
        with pytest.raises(ValueError, match="no usable mass: .'x'"):
            evidence.neutral_mass(spark.createDataFrame(bad, rows.schema), "query", exact="exact")


def test_the_threefold_gate(spark):
    rows = spark.createDataFrame([(0.9, 0.7, 6), (0.89, 0.7, 6), (0.9, 0.69, 6), (0.9, 0.7, 5), (None, 0.9, 9)], "max_direct double, explained double, matched int")
    assert [r[0] for r in rows.select(ranking.confident()).collect()] == [True, False, False, False, False]


def test_blocks_grow_with_windows_that_are_drawn_from(spark, monkeypatch):
    """A query is moved to a bounded number of blocks however many rows its window has, and the hits are those of small blocks."""
    lib = spark.range(4000).select(F.col("id").alias("cid"), (F.col("id") % 50).alias("key"), (100 + F.col("id") / 100).alias("mass"), F.array(F.struct((F.col("id") % 9 + 10.0).alias("mz"), (F.col("id") % 4 + 1.0).alias("intensity"))).alias("peaks"), F.lit("p").alias("mode"))
    q = lib.filter("cid % 400 = 7").drop("key").withColumnRenamed("cid", "qid")
    sent, plain = [], blocks.met
    monkeypatch.setattr(blocks, "met", lambda *a: sent.append(a[0].count()) or plain(*a))
    rows = []
    for across in (1 << 20, 4):
        monkeypatch.setattr(blocks, "ACROSS", across)
        found = blocks.hits(q, places.placed(lib, 16), F.lit(5.0), 0.5, 40, 0, 300).select("qid", "cid", "score").collect()
        best = {}
        for r in sorted(found, key=lambda r: (-round(r.score, 9), r.cid)):
            best.setdefault(r.qid, []).append((r.cid, round(r.score, 9)))
        rows.append({k: v[:40] for k, v in best.items()})
    assert rows[0] == rows[1] and len(rows[0]) == 10
    assert sent[1] <= 6 * 10 < sent[0] / 5


def test_drawn_pairs_compare_their_own_peaks():
    """Where few spectra of a block are drawn, the pairs' peaks alone give the scores of the look-ups."""
    rng = np.random.default_rng(5)

    def made(n):
        size = rng.integers(0, 5, n)
        start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        mz = np.concatenate([np.sort(rng.uniform(0, 60, k)) for k in size])
        return blocks.Peaks(matching.Spectra(start, mz, rng.uniform(0.1, 1, len(mz))), np.sort(rng.uniform(50, 90, n)))

    block, q = blocks.Block(made(400), 1000, 2.0, "Da"), made(30)
    first, n = rng.integers(900, 1100, 30), rng.integers(1, 500, 30)
    for most in (1, 7, 40):
        for a, b in zip(block.scores(q, first, n, most), block.scores(q, first, n, most, cross=True), strict=True):
            assert np.array_equal(a, b) if a.dtype.kind == "i" else np.allclose(a, b, rtol=0, atol=1e-12)
