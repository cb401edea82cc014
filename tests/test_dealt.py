"""What a task ranks stays the same however large the tables are."""

import pytest
from pyspark.sql import functions as F

from affinis.operators import metrics, ranking
from affinis.plans import queries
from affinis.store import settled

DIR = "/root/testdata/sf0.001"


def sizes(rows):
    """Rows of each partition."""
    return [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


@pytest.mark.parametrize("by", [("query",), ("query", "key")])
def test_candidates_are_dealt_by_their_number(spark, monkeypatch, by):
    lines = queries.t(spark, DIR, "lineitem").count()
    monkeypatch.setattr(ranking, "TASK_ROWS", lines // 40)
    rows = queries.candidates_of(spark, DIR, by)
    assert rows.rdd.getNumPartitions() == -(-lines // (lines // 40))
    assert max(sizes(rows)) < lines / 10
    monkeypatch.setattr(ranking, "TASK_ROWS", 1 << 30)
    again = queries.candidates_of(spark, DIR, by)
    assert again.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("name", ["borda", "rrf", "rrf_union_raw_rank", "score_fusion_z", "score_fusion_minmax"])
def test_fusions_stay_where_the_candidates_were_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(ranking, "TASK_ROWS", queries.t(spark, DIR, "lineitem").count() // 40)
    assert getattr(queries, name)(spark, DIR).rdd.getNumPartitions() >= 40


def test_ranks_of_dealt_channels_feed_the_recall(spark, monkeypatch):
    plain = sorted(map(tuple, metrics.channel_recall(queries.truth_of(spark, DIR).select("query", "truth"), queries.channels_of(spark, DIR), [1, 25]).collect()))
    monkeypatch.setattr(ranking, "TASK_ROWS", 100)
    assert sorted(map(tuple, metrics.channel_recall(queries.truth_of(spark, DIR).select("query", "truth"), queries.channels_of(spark, DIR), [1, 25]).collect())) == plain


def test_a_submission_is_made_once_for_all_its_faults(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "settled", lambda rows: made.append(rows) or settled(rows))
    rows = queries.submission_faults(spark, DIR)
    assert len(made) == 1
    assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in rows.inputFiles())
