"""Expected Tanimoto similarities without pairs as rows."""

import numpy as np
from pyspark.sql import functions as F

from affinis.operators import features, kernels
from affinis.plans import details


def test_parts_give_what_all_pairs_give(spark, monkeypatch):
    random = np.random.default_rng(5)
    p = random.random((60, 8)).round(2)
    bits = (random.random((150, 8)) > 0.5).astype(int)
    bits[100:] = bits[:50]  # equal candidates, which go by their keys
    q = spark.createDataFrame([(i, i % 3 if i < 57 else None, [float(x) for x in p[i]]) for i in range(60)], "query long, g int, p array<double>")
    c = spark.createDataFrame([(i, i % 4, [int(x) for x in bits[i]]) for i in range(150)], "key long, g int, bits array<int>")
    want = features.by_expected_tanimoto(q.join(c, "g"), 7).select("query", "key", "similarity_rank", F.round("similarity", 9).alias("s"))
    want = sorted(map(tuple, want.collect()))
    for compared in ((1024, 4096), (5, 6), (1, 1000)):
        monkeypatch.setattr(features, "COMPARED", compared)
        got = features.nearest_by_expected_tanimoto(q, c, 7, "g").select("query", "key", "similarity_rank", F.round("similarity", 9).alias("s"))
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) == 57 * 7


def test_zero_vectors_agree(spark):
    q = spark.createDataFrame([(1, 0, [0.0, 0.0])], "query long, g int, p array<double>")
    c = spark.createDataFrame([(1, 0, [0, 0]), (2, 0, [1, 0])], "key long, g int, bits array<int>")
    assert [(r.key, r.similarity) for r in features.nearest_by_expected_tanimoto(q, c, 5, "g").orderBy("similarity_rank").collect()] == [(1, 1.0), (2, 0.0)]


def test_pairs_are_no_rows(spark):
    plan = details.expected_tanimoto_rank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_packing_makes_its_array_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(n):
        made.add(1)
        return [i % 3 == 0 for i in range(n)]

    bits = F.udf(counted, "array<boolean>").asNondeterministic()
    rows = spark.range(7).select(kernels.unpacked(kernels.packed(F.transform(bits(F.lit(70)), lambda x: x)), 70).alias("b"))
    assert [r.b for r in rows.collect()] == [[i % 3 == 0 for i in range(70)]] * 7
    words = kernels.unpacked(kernels.packed(F.transform(F.col("e"), lambda x: x > 0)), 64)
    plan = spark.createDataFrame([([1.0, -1.0],)], "e array<double>").select(words.alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(e#") == 1 and ".get(" not in plan and "get(transform(" not in plan
