"""Order of the input, and iteration in bounded batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import ranking
from affinis.sources import tables


def test_input_order(spark, tmp_path):
    path = str(tmp_path / "rows")
    # Three files, written one after another; the order of ids is not that of the input.
    for ids in ([9, 3, 5], [], [1, 7, 8, 2]):
        spark.createDataFrame([(i, i % 2, "x") for i in ids], "id int, g int, v string").coalesce(1).write.mode("append").parquet(path)
    rows = tables.in_input_order(spark, path)
    files = {r.file: r.ids for r in rows.groupBy(F.col("input_order.file").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("input_order", "id"))), lambda x: x["id"]).alias("ids")).collect()}
    assert sorted(files.values()) == [[1, 7, 8, 2], [9, 3, 5]]
    want = [i for f in sorted(files) for i in files[f]]
    assert [r.id for r in rows.repartition(7).orderBy("input_order").collect()] == want
    first = {r.g: r.id for r in ranking.first_of(rows.repartition(5), ["g"], F.col("v"), F.col("input_order")).collect()}
    assert first == {g: next(i for i in want if i % 2 == g) for g in (0, 1)}
    spark.range(2).withColumn("input_order", F.lit(1)).write.parquet(str(tmp_path / "taken"))
    with pytest.raises(ValueError):
        tables.in_input_order(spark, str(tmp_path / "taken"))


def test_iterated(spark):
    rows = spark.range(0, 1003, numPartitions=7)
    for prefetch in (True, False):
        got = list(tables.iterated(rows, 100, prefetch))
        assert [len(b) for b in got] == [100] * 10 + [3] and [r.id for b in got for r in b] == list(range(1003))
    assert list(tables.iterated(rows.filter("id < 0"), 10)) == []
    # A caller may stop early.
    assert len(next(tables.iterated(rows, 5))) == 5
    with pytest.raises(ValueError):
        next(tables.iterated(rows, 0))


def test_arrays_in_ranges(spark, tmp_path):
    n = 1003
    columns = {"mass": np.arange(n) / 7, "id": np.arange(n), "name": np.array([f"n{i % 11}" for i in range(n)]), "big": np.arange(n, dtype=">i4")}
    (tmp_path / "a").mkdir()
    np.savez(tmp_path / "a" / "plain.npz", **columns)
    np.savez_compressed(tmp_path / "a" / "packed.npz", **{k: v[:200] for k, v in columns.items()})
    np.savez(tmp_path / "a" / "none.npz", **{k: v[:0] for k, v in columns.items()})
    rows = tables.read_arrays(spark, str(tmp_path / "a"), "id long, mass double, name string, big int", rows_per_task=100, batch_size=33)
    want = sorted([(i, i / 7, f"n{i % 11}", i) for i in range(n)] + [(i, i / 7, f"n{i % 11}", i) for i in range(200)])
    assert sorted(tuple(r) for r in rows.collect()) == want
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r.id for r in tables.read_arrays(spark, str(tmp_path / "a"), "id long").collect()) == [w[0] for w in want]
    for name, arrays in (("short", {"id": np.arange(3), "mass": np.arange(2.0)}), ("flat", {"id": np.zeros((2, 2), int), "mass": np.arange(2.0)}), ("object", {"id": np.array([{}, 1], object), "mass": np.arange(2.0)}), ("lacks", {"id": np.arange(2)})):
        np.savez(tmp_path / f"{name}.npz", **arrays)
        with pytest.raises(Exception, match="equal length|objects|missing"):
            tables.read_arrays(spark, str(tmp_path / f"{name}.npz"), "id long, mass double").collect()
    with pytest.raises(ValueError):
        tables.read_arrays(spark, str(tmp_path), "id long", rows_per_task=0)
