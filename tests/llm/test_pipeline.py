"""The pipeline's stages, each against what its operator decides on the stage's own input."""

import corpus_pipeline
import duckdb
import pandas as pd
import pytest

from affinis.llm import decontam, simhash
from affinis.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, DIR).toPandas(), docs.schema)
        assert docs.columns == before.columns and docs.count(), name
        if name == "near_dedup":
            found = simhash.near_duplicates(before).toPandas()
            assert sorted(r.doc_id for r in docs.collect()) == sorted(found.component_id.unique())
        if name == "decontamination":
            assert not any(i in decontam.normal(r.text) for r in docs.collect() for i in items)
            exact = sum(any(i in decontam.normal(r.text) for i in items) for r in before.collect())
            assert before.count() - docs.count() >= exact > 0
    report = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).toPandas()
    assert sorted(report.slot) == list(range(len(report)))
    assert {i for ids in report.doc_ids for i in ids} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.sql(ORACLE_SQL[name]).df()
    key = got.columns[0]
    got, want = (x[list(got.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12)
