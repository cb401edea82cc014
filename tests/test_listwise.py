"""The list-wise ranker: lambda gradients and histograms against plain loops, gains against the objective, held-out NDCG, odd input, models on disk."""

import math
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import features, listwise
from affinis.plans import composite

ROWS = "query long, key long, target int, score double, a double, b double"


def candidates(seed, queries=30, most=12):
    r = random.Random(seed)
    out = []
    for q in range(queries):
        n = r.randrange(1, most)
        true = r.randrange(n)
        out += [(q, k, int(k == true and q % 6 > 0), float(r.randrange(-2, 3)), r.random() + 0.5 * (k == true), float(r.randrange(5))) for k in range(n)]
    return out


def plain_lambdas(rows):
    out = {}
    for q, group in groupby(sorted(rows), key=lambda x: x[0]):
        order = sorted(group, key=lambda x: (-x[3], x[1]))
        place = {x[1]: i for i, x in enumerate(order, 1)}
        g, h = dict.fromkeys(place, 0.0), dict.fromkeys(place, 0.0)
        for p in order:
            for n in order:
                if p[2] == 1 and n[2] == 0:
                    rho = 1 / (1 + math.exp(p[3] - n[3]))
                    delta = abs(1 / math.log2(1 + place[p[1]]) - 1 / math.log2(1 + place[n[1]]))
                    g[p[1]] -= rho * delta
                    g[n[1]] += rho * delta
                    h[p[1]] += rho * (1 - rho) * delta
                    h[n[1]] += rho * (1 - rho) * delta
        out |= {(q, k): (place[k], g[k], h[k]) for k in place}
    return out


def test_lambdas(spark):
    rows = candidates(1)
    got = {(r.query, r.key): (r.place, r.g, r.h) for r in listwise.lambdas(spark.createDataFrame(rows, ROWS).repartition(3)).collect()}
    want = plain_lambdas(rows)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_histograms_and_trees(spark):
    r = np.random.default_rng(2)
    bins, g, h = r.integers(0, 8, (200, 3)).astype(np.uint8), r.normal(size=200), r.random(200)
    now = spark.createDataFrame([(x.tobytes(), float(a), float(b)) for x, a, b in zip(bins, g, h, strict=True)], "bins binary, g double, h double").repartition(4)
    tree = listwise.Tree([1, -1, -1], [3, 0, 0], [0.0] * 3, [0.0] * 3, 1)
    got = listwise.histograms(now, tree, 3, 8)
    for node, mask in enumerate((bins[:, 1] <= 3, bins[:, 1] > 3)):
        for f in range(3):
            for b in range(8):
                on = mask & (bins[:, f] == b)
                assert np.allclose(got[node, f, b], [g[on].sum(), h[on].sum(), on.sum()])
    assert (tree.leaves(bins) == np.where(bins[:, 1] > 3, 2, 1)).all()


def test_gains_are_what_the_objective_loses(spark):
    model = listwise.fit(spark.createDataFrame(candidates(3, 120), ROWS), ["a", "b"], trees=5, depth=3, rate=0.5, least=2, patience=99)
    assert 0 < len(model.trees) == len(model.drops) and sum(model.splits) == sum(f >= 0 for t in model.trees for f in t.feature)
    assert math.isclose(sum(model.gain), sum(model.drops), rel_tol=1e-9) and model.gain[0] > model.gain[1]
    assert len(model.ndcg[0]) == 4 and model.ndcg[len(model.trees)][2] == max(x[2] for x in model.ndcg)
    again = listwise.fit(spark.createDataFrame(candidates(3, 120), ROWS).repartition(7), ["a", "b"], trees=5, depth=3, rate=0.5, least=2, patience=99)
    assert [t.feature for t in again.trees] == [t.feature for t in model.trees] and np.allclose(again.gain, model.gain)


def ndcg10(rows, order):
    top = rows.withColumn("__r", F.row_number().over(listwise.Window.partitionBy("query").orderBy(*order)))
    return top.filter("target = 1").agg(F.avg(F.when(F.col("__r") <= 10, 1 / F.log2(F.col("__r") + 1)).otherwise(0.0))).first()[0]


def test_better_than_single_candidates(spark):
    """On queries that neither saw, above trees on single candidates, and far above the order by mass."""
    rows = composite.learning_frame(spark, "/root/testdata/sf0.001").cache()
    seen = F.pmod(F.xxhash64(F.lit(1), "query"), F.lit(5)) > 0
    train, rest = rows.filter(seen), rows.filter(~seen)
    model = listwise.fit(train, composite.LEARNT, trees=12, depth=3, rate=0.3, least=5)
    single = features.pointwise_ranker(train.withColumn("target", F.col("target").cast("double")), composite.LEARNT, trees=12, depth=3)
    ours = ndcg10(model.score(rest), [F.col("ranker_score").desc(), "key"])
    theirs = ndcg10(single.transform(rest), [F.col("ranker_score").desc(), "key"])
    plain = ndcg10(rest, [F.col("mass_rank")])
    rows.unpersist()
    assert ours > theirs and ours > plain, (ours, theirs, plain)


def test_odd_input(spark, tmp_path):
    of = lambda rows: spark.createDataFrame(rows, ROWS)
    for rows, what in (([(1, 1, 2, 0.0, 0.0, 0.0)], "targets"), ([(1, 1, None, 0.0, 0.0, 0.0)], "targets"), ([(1, i, 1, 0.0, 0.0, 0.0) for i in range(2)], "targets"), ([], "two queries"), ([(1, 1, 1, 0.0, 0.0, 0.0)], "two queries")):
        with pytest.raises(ValueError, match=what):
            listwise.fit(of(rows), ["a"])
    with pytest.raises(ValueError, match="missing columns: .*zzz"):
        listwise.fit(of(candidates(1)), ["a", "zzz"])
    rows = [(q, k, int(k == 0), 0.0, [None, float("nan"), float("inf"), 1.0][k % 4], -1.0) for q in range(40) for k in range(4)]
    model = listwise.fit(of(rows), ["a", "b"], trees=3, depth=2, least=2)
    out = listwise.ranked(of(rows), model)
    assert out.count() == 160 and out.filter("ranker_score IS NULL OR isnan(ranker_score)").count() == 0 and {r[0] for r in out.select("final_rank").distinct().collect()} == {1, 2, 3, 4}
    assert model.score(of([])).count() == 0
    flat = listwise.fit(of([(q, k, int(k == 0), 0.0, 1.0, 1.0) for q in range(9) for k in range(3)]), ["a"], trees=3)
    assert flat.trees == [] and flat.gain == [0.0]
    model.save(spark, str(tmp_path / "m"))
    back = listwise.Ranker.load(spark, str(tmp_path / "m"), ["a", "b"])
    assert back == model and [tuple(r) for r in back.importance(spark).collect()] == [("a", *map(float, model.gain[:1]), model.splits[0]), ("b", float(model.gain[1]), model.splits[1])]
    with pytest.raises(ValueError, match="features"):
        listwise.Ranker.load(spark, str(tmp_path / "m"), ["b", "a"])
    with pytest.raises(ValueError, match="missing columns"):
        model.score(of(rows).drop("b"))


def test_queries_are_dealt_once(spark, monkeypatch):
    """Trees need no shuffle of the rows: the windows of each find the queries where they lie."""
    plans, given = [], listwise.lambdas

    def kept(rows, *a):
        out = given(rows, *a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(listwise, "lambdas", kept)
    model = listwise.fit(spark.createDataFrame(candidates(3, 60), ROWS), ["a", "b"], trees=3, depth=2, least=2)
    assert model.trees and len(plans) > 1 and all("Exchange" not in p.split("InMemoryTableScan")[0] for p in plans)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
