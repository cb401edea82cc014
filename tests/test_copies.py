"""Tables that repeat their rows under other keys: the work goes with what is different, the results with all rows."""

import random

import pytest
from pyspark.sql import functions as F

from affinis.operators import blocks, joins, retrieval
from affinis.operators.places import placed

SPECTRUM = "mass double, peaks array<struct<mz:double,intensity:double>>, mode string"


def _spectra(spark, copies: int, seed: int = 3):
    rng = random.Random(seed)
    kinds = [(100 + 3 * (i // 4), sorted((rng.choice([10.0, 20.0, 30.0, 40.0]), float(rng.randint(1, 9))) for _ in range(3)), rng.choice(["p", "n", None])) for i in range(24)]
    kinds += [(500.0, [(10.0, 1.0)], "p"), (501.0, [(10.0, 1.0)], "n"), (900.0, None, None), (float("nan"), [(10.0, 1.0)], "p")]
    rows = [(c * len(kinds) + i, i % 7, float(m), p, mode) for c in range(copies) for i, (m, p, mode) in enumerate(kinds) if c == 0 or m not in (500.0, 501.0)]
    return spark.createDataFrame(rows, "cid long, key long, " + SPECTRUM)


@pytest.mark.parametrize(("copies", "top_n"), [(1, 3), (2, 3), (5, 3), (5, 40)])
@pytest.mark.parametrize("how", [{"ppm": 20000.0}, {"da": 2.5}])
def test_search_of_copies(spark, copies, top_n, how):
    library = _spectra(spark, copies)
    more = spark.createDataFrame([(-1, 300.0, [(10.0, 2.0)], "p"), (-2, 101.5, [(20.0, 2.0)], "x")], "qid long, " + SPECTRUM)
    queries = library.drop("key").withColumnRenamed("cid", "qid").unionByName(more)
    got, want = (sorted(map(str, retrieval.search(queries, x, tolerance=0.5, top_n=top_n, **how).collect())) for x in (library, placed(library)))
    assert got == want and got


def test_copies_are_searched_once(spark, monkeypatch):
    asked, held = [], []
    hits = blocks.hits

    def counted(queries, places, *more):
        asked.append(queries.count())
        held.append(places.total)
        return hits(queries, places, *more)

    monkeypatch.setattr(blocks, "hits", counted)
    library = _spectra(spark, 9).filter("mass < 500")
    retrieval.search(library.drop("key").withColumnRenamed("cid", "qid"), library, ppm=20000.0, tolerance=0.5, top_n=3).count()
    assert max(asked) <= 24 and max(held) <= 24


@pytest.mark.parametrize(("method", "copies", "top_n", "limit"), [("topk", 4, 5, 4), ("mean", 3, 60, 25), ("max", 1, 3, 2)])
@pytest.mark.parametrize("how", [{"ppm": 20000.0}, {"da": 2.5}])
def test_queries_of_equal_spectra_share_lists(spark, monkeypatch, method, copies, top_n, limit, how):
    """Evidence inside the tasks is that of the hits as rows, also where queries have neighbours by place, and many tasks and parts."""
    monkeypatch.setattr(retrieval, "LISTS", 5)
    monkeypatch.setattr(retrieval, "SHARERS", 2)
    monkeypatch.setattr(blocks, "HELD", 50)
    library = _spectra(spark, copies)
    more = spark.createDataFrame([(-1, 300.0, [(10.0, 2.0)], "p", 90), (-2, 101.5, [(20.0, 2.0)], "x", 91), (-3, 103.0, [(20.0, 2.0)], "n", 90)], "qid long, " + SPECTRUM + ", query long")
    queries = library.select(F.col("cid").alias("qid"), "mass", "peaks", "mode", (F.col("cid") / 3).cast("long").alias("query")).unionByName(more)
    rows = lambda: sorted((r.query, r["rank"], r.key, round(r.evidence, 9)) for r in retrieval.predict(queries, library, method, limit, tolerance=0.5, top_n=top_n, **how).collect())
    shared, made = retrieval._shared, []
    monkeypatch.setattr(retrieval, "_shared", lambda *a: made.append(1) or shared(*a))
    got = rows()
    monkeypatch.setattr(retrieval, "SHARED", ())
    assert got == rows() and got and made == [1]


def test_peaks_with_nulls_and_names(spark):
    """Spectra whose peaks are the same without those that hold a null share a name; a null in another place makes no name alike."""
    of = [[(1.0, 2.0)], [(1.0, 2.0), (3.0, None)], [(1.0, None), (None, 2.0)], [], None, [(2.0, 1.0)]]
    rows = spark.createDataFrame([(i, 100.0, p, "p") for i, p in enumerate(of)], "cid long, " + SPECTRUM)
    names = {r["cid"]: tuple(r[c] for c in retrieval.NAME) for r in retrieval.named(rows).collect()}
    assert names[0] == names[1] and names[2] == names[3] == names[4] and len(set(names.values())) == 3


def test_peaks_meet_few_rows(spark, monkeypatch):
    """Only one row of each kind takes its peaks along: what is named goes without them."""
    wide = []
    join = type(spark.range(1)).join

    def seen(self, other, *more, **how):
        wide.append("peaks" in self.columns and "peaks" in other.columns)
        return join(self, other, *more, **how)

    monkeypatch.setattr(type(spark.range(1)), "join", seen)
    library = _spectra(spark, 3).filter("mass < 500")
    retrieval.search(library.drop("key").withColumnRenamed("cid", "qid"), library, ppm=20000.0, tolerance=0.5, top_n=3).count()
    assert wide and not any(wide)


def test_blocks_fit_the_windows(spark):
    library = spark.range(4000).select(F.col("id").alias("cid"), (1000 + F.col("id") / 100).alias("mass"), F.expr("array(named_struct('mz', 1D, 'intensity', 1D))").alias("peaks"))
    places = blocks.fitted(placed(library, 10), lambda mass: 2 + 0 * mass)
    assert 200 <= places.size <= 800 and len(places.lows) == -(-4000 // places.size)
    assert places.masses.count() == len(places.lows)
    assert [r[0] for r in places.masses.orderBy("__block").selectExpr("__masses[0]").collect()] == places.lows.tolist()


def _masses(spark, queries: int = 40, copies: int = 30):
    """Queries of several copies, one id with two masses, against library rows that repeat each of 20 masses."""
    q = spark.createDataFrame([(c * 100 + i, 100 + i * 0.003 + 1e-4 * (i % 3)) for c in range(copies) for i in range(queries)] + [(3, 100.05), (4, float("nan")), (5, None), (6, -1.0)], "qid long, mass double")
    lib = spark.createDataFrame([(c * 100 + i, 100 + i * 0.006, "ab"[i % 2] if i % 5 else None) for c in range(copies) for i in range(20)], "cid long, mass double, formula string")
    return q, lib


def test_nearest_make_few_pairs(spark):
    q, lib = _masses(spark)
    made = []

    def window(a, b):
        made.append(joins.mass_window(a, b, 60.0))
        return made[-1]

    got = joins.nearest_in(q, lib, 3, window).select("qid", "query_mass", "cid", "mass_rank")
    want = joins.nearest_first(joins.mass_window(q, lib, 60.0), 3).select("qid", "query_mass", "cid", "mass_rank")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count()
    assert made[0].count() <= 3 * 41 * 20 < joins.mass_window(q, lib, 60.0).count()


def test_lists_of_equal_masses(spark, monkeypatch):
    q, lib = _masses(spark)
    monkeypatch.setattr(joins, "ALIKE", 4)  # lists are divided
    pairs = joins.mass_window(q, lib, 60.0)
    plain = q.withColumnRenamed("mass", "query_mass").join(lib, (F.col("query_mass") > 0) & F.expr("mass BETWEEN query_mass - query_mass * 60e-6 AND query_mass + query_mass * 60e-6"))
    assert sorted(pairs.select("qid", "cid").collect()) == sorted(plain.select("qid", "cid").collect())
    assert max(r[0] for r in joins._listed(lib.drop("formula"), ["mass"]).select(F.size("__alike")).collect()) < 30
    same = joins.mass_and_formula(lib.withColumnRenamed("cid", "qid"), lib, 60.0)
    a = lib.select(F.col("cid").alias("qid"), F.col("mass").alias("query_mass"), F.col("formula").alias("f"))
    want = a.join(lib, F.expr("f = formula AND mass BETWEEN query_mass - query_mass * 60e-6 AND query_mass + query_mass * 60e-6"))
    assert sorted(same.select("qid", "cid").collect()) == sorted(want.select("qid", "cid").collect())
    near = joins.formula_near(a.withColumnRenamed("f", "formula"), lib, F.col("query_mass") * (1 - 60e-6), F.col("query_mass") * (1 + 60e-6))
    assert near.count() == want.count()


def test_screening_ranks_before_pairs(spark, monkeypatch):
    from jobs import screening

    held = []
    widened = joins.widened
    monkeypatch.setattr(joins, "widened", lambda q, c, *more, **named: held.append((q.count(), c.count())) or widened(q, c, *more, **named))
    q, lib = _masses(spark)
    config = {"query": {"id": ["qid"], "mass": "mass"}, "library": {"id": "cid", "mass": "mass", "source": "formula"}, "narrow_ppm": 5.0, "wide_ppm": 60.0, "top": 2}
    rows = screening.screened(q, lib, config)
    assert held and held[0][0] <= 44 and held[0][1] <= 2 * 20
    asked = q.distinct().withColumn("row", F.struct("qid", "mass"))
    want = joins.nearest_first(widened(asked.drop("qid"), lib, 5.0, 60.0, query="row"), 2, query="row")
    assert sorted(rows.filter("channel <> 'none'").select("qid", "mass", "candidate", "mass_rank").collect()) == sorted(want.select("row.qid", "row.mass", "cid", "mass_rank").collect())
    assert rows.filter("channel = 'none'").count() == asked.count() - want.select("row").distinct().count()


@pytest.mark.parametrize("more", [[], ["size"]])
def test_pairs_of_copies_are_dealt_by_rows_made(spark, more):
    """Rows alike are compared once on either side, and what takes the lists apart has many tasks, though the lists are a few bytes."""
    lib = spark.range(150).select(F.col("id").alias("cid"), (100.0 + F.col("id") % 3 * 0.001).alias("mass"), F.lit("f").alias("formula"), (F.col("id") % 7).alias("size"))
    lib = lib.withColumn("cid", F.when(F.col("cid") != 5, F.col("cid"))).select("cid", "mass", "formula", *more)
    q = lib.withColumnRenamed("cid", "qid").withColumnsRenamed({c: f"q_{c}" for c in more})
    a = q.withColumnRenamed("mass", "query_mass")
    near = F.abs(F.col("mass") - F.col("query_mass")) <= F.col("query_mass") * 11e-6
    want = sorted(map(str, a.join(lib.drop("formula"), near).select("qid", "cid", *more).collect()))
    assert len(want) == 150 * 150 - 2 * 50 * 50
    made = {
        "channels": joins.channels(q.drop("formula"), lib.drop("formula"), [5.0, 11.0]),
        "formula": joins.mass_and_formula(q, lib, 11.0),
        "near": joins.formula_near(a, lib, F.col("query_mass") * (1 - 11e-6), F.col("query_mass") * (1 + 11e-6)),
    }
    for name, pairs in made.items():
        assert sorted(map(str, pairs.select("qid", "cid", *more).collect())) == want, name
        assert pairs.rdd.getNumPartitions() >= joins.DEALT, name
    told = {(r.mass == r.query_mass, tuple(r.tolerances), r.least_ppm) for r in made["channels"].collect()}
    assert told == {(True, (5.0, 11.0), 5.0), (False, (11.0,), 11.0)}
