"""The jobs: two runs over growing input, runs that are cut off, odd rows, the command line; the queries against their SQL."""

import json
import logging
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobs import screening, text_splits
from jobs.common import config_of
from jobs.queries import ORACLE_SQL, QUERIES

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
SCREEN = config_of(f"{REPO}/jobs/screening.json", screening.KEYS)
SPLIT = config_of(f"{REPO}/jobs/text_splits.json", text_splits.KEYS)
ITEMS = "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double"


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    plain = lambda df: sorted((tuple("" if pd.isna(v) else round(v, 5) if isinstance(v, float) else str(v) if isinstance(v, str) else float(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)
    assert plain(got) == plain(want)


def put(spark, rows, folder, mode="append"):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode(mode).parquet(str(folder))


@pytest.fixture
def library(spark, tmp_path):
    path = str(tmp_path / "library")
    spark.createDataFrame([(1, "a", 100.0), (2, "b", 100.0), (3, "c", 100.05), (4, "d", 500.0), (5, "e", None)], "p_partkey long, p_brand string, p_retailprice double").write.parquet(path)
    return path


def rows_of(df):
    return sorted(((r.l_orderkey, r.l_linenumber, r.candidate, r.mass_rank, r.channel, r.batch) for r in df.collect()), key=str)


def said(caplog):
    got = [r.getMessage() for r in caplog.records if r.name == "screening" and "batch " in r.getMessage()]
    caplog.clear()
    return [int(x.split("read ")[1].split()[0]) for x in got]


def test_screening_takes_only_what_is_new(spark, tmp_path, library, caplog):
    """Nothing, then rows with nulls and repeated ones, then nothing new, then one more file; settings stay as they were."""
    caplog.set_level(logging.INFO)
    news, out, settings = tmp_path / "news", f"file://{tmp_path}/out", dict(spark.conf.getAll)
    put(spark, [], news)
    run = lambda: rows_of(screening.run(spark, str(news), library, out, SCREEN))
    assert run() == []
    said(caplog)
    put(spark, [(1, 1, 100.0, 1.0), (1, 2, 200.1, 2.0), (2, 1, 7.0, 0.0), (2, 1, 7.0, 0.0), (None, 1, None, None), (3, 1, 100.02, 1.0), (4, 1, float("nan"), 1.0)], news)
    one = run()
    n = one[0][-1]
    assert one == sorted([(1, 1, 1, 1, "narrow", n), (1, 1, 2, 2, "narrow", n), (1, 2, 3, 1, "narrow", n), (2, 1, None, None, "none", n), (None, 1, None, None, "none", n), (4, 1, None, None, "none", n), (3, 1, 1, 1, "wide", n), (3, 1, 2, 2, "wide", n), (3, 1, 3, 3, "wide", n)], key=str)
    assert said(caplog) == [6]
    assert run() == one and said(caplog) == []
    put(spark, [(9, 1, 500.0, 1.0)], news)
    two = run()
    assert said(caplog) == [1] and sorted(set(two) - set(one), key=str) == [(9, 1, 4, 1, "narrow", n + 1)] and set(one) < set(two)
    assert dict(spark.conf.getAll) == settings


def test_a_batch_that_was_cut_off_is_taken_again(spark, tmp_path, library, monkeypatch):
    """The rows were written, the batch was not done: the next run replaces them."""
    news, out = tmp_path / "news", f"file://{tmp_path}/out"
    put(spark, [(i, 1, 100.0 + i % 2, 1.0) for i in range(20)], news)
    info = screening.LOG.info
    monkeypatch.setattr(screening.LOG, "info", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        screening.run(spark, str(news), library, out, SCREEN)
    assert any((tmp_path / "out/rows").rglob("*.parquet"))
    monkeypatch.setattr(screening.LOG, "info", info)
    once = rows_of(screening.run(spark, str(news), library, out, SCREEN))
    assert once == rows_of(screening.run(spark, str(news), library, f"file://{tmp_path}/other", SCREEN)) and len(once) == 30


def test_screening_grows_with_copies_of_a_table(spark, tmp_path):
    """The table in two halves gives the rows of the whole."""
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").dropDuplicates(["l_orderkey", "l_linenumber"])
    news, out = str(tmp_path / "news"), f"file://{tmp_path}/out"
    for part in (0, 1):
        rows.filter(F.col("l_orderkey") % 2 == part).write.mode("append").parquet(news)
        got = screening.run(spark, news, f"{DATA}/part.parquet", out, SCREEN)
    whole = screening.screened(spark.read.parquet(news), spark.read.parquet(f"{DATA}/part.parquet"), SCREEN)
    assert sorted(map(str, got.select(*whole.columns).collect())) == sorted(map(str, whole.collect())) and got.select("batch").distinct().count() == 2


def test_splits_of_odd_texts(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    docs = [(1, "A  b\nc", "en", "s", "x"), (2, " a b c", "en", "s", "x"), (3, None, None, None, None), (4, "", "en", "s", "x"), (5, "long " * 50_000, "de", "s", "x"), (1, "A  b\nc", "en", "s", "x"), (None, "\u00c4 b", "de", "s", "x"), (6, "\u00e4 b", "de", "s", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, fold string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, 1, 0), (1, 0, None), (5, None, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "l"))
    run = lambda: text_splits.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), f"file://{tmp_path}/out", SPLIT)
    got = {r.doc_id: r for r in run().collect()}
    assert len(got) == 7 and got[1].key == got[2].key and got[1].fold == got[2].fold and (got[1].first, got[2].first) == (True, False)
    assert got[3].key == got[4].key and got[None].key != got[6].key and (got[1].quality, got[1].toxic, got[5].quality, got[5].toxic, got[2].quality) == (1, 0, None, 1, None)
    assert "read 8 documents" in caplog.text and "wrote 7 rows" in caplog.text
    assert {r.doc_id: r for r in run().collect()} == got
    report = [json.loads(x) for p in (tmp_path / "out/report").glob("*.json") for x in p.read_text().splitlines()]
    assert sum(r["documents"] for r in report) == 7 and sum(r["texts"] for r in report) == 5
    empty = spark.read.parquet(str(tmp_path / "d")).limit(0)
    empty.write.parquet(str(tmp_path / "none"))
    assert text_splits.run(spark, str(tmp_path / "none"), str(tmp_path / "l"), f"file://{tmp_path}/nothing", SPLIT).count() == 0


def test_a_leak_is_an_error(spark, tmp_path, monkeypatch):
    real = text_splits.splits
    monkeypatch.setattr(text_splits, "splits", lambda *a: real(*a).withColumn("fold", (F.col("doc_id") % 2).cast("smallint")))
    with pytest.raises(ValueError, match="several folds"):
        text_splits.run(spark, f"{DATA}/documents.parquet", f"{DATA}/labels.parquet", f"file://{tmp_path}/out", SPLIT)


def test_texts_are_read_once(spark, tmp_path, monkeypatch):
    """What is dealt into folds comes from rows that are kept, and they are let go."""
    real, kept = text_splits.splits, []
    monkeypatch.setattr(text_splits, "splits", lambda *a: kept.append(a[3].storageLevel.useDisk) or real(*a))
    text_splits.run(spark, f"{DATA}/documents.parquet", f"{DATA}/labels.parquet", f"file://{tmp_path}/out", SPLIT)
    assert kept == [True] and not spark.sparkContext._jsc.getPersistentRDDs()


def test_command_lines(tmp_path):
    shutil.copy(f"{REPO}/jobs/text_splits.json", tmp_path / "c.json")
    call = [sys.executable, "-m", "jobs.text_splits", "--config", str(tmp_path / "c.json"), "--documents", f"{DATA}/documents.parquet", "--labels", f"{DATA}/labels.parquet", "--out", f"file://{tmp_path}/out"]
    done = subprocess.run(call, cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote 200 rows in 5 folds" in done.stderr, done.stderr[-2000:]
    assert sorted(p.name for p in (tmp_path / "out/splits").glob("fold=*")) == [f"fold={i}" for i in range(5)]
    (tmp_path / "c.json").write_text('{"folds": 3}')
    assert subprocess.run(call, cwd=REPO, capture_output=True, text=True, timeout=300).returncode != 0


def test_jobs_stand_alone():
    """Neither the jobs nor their tests use the optional subpackage or the pipeline."""
    for p in [*Path(REPO, "jobs").glob("*.py"), Path(__file__)]:
        code = [x for x in p.read_text().splitlines() if "import" in x]
        assert not any(w in x for x in code for w in ("affinis.llm", "corpus" + "_pipeline") if '"' not in x)
