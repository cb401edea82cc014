"""Leakage-safe splits of labelled texts: texts that are the same but for case and white space never fall into different folds.

    python -m jobs.text_splits --config jobs/text_splits.json --documents PATH --labels PATH --out PATH

PATH/splits gets a row for each document, a folder for each fold; PATH/report a JSON line for each fold and language.
"""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import metrics, ranking, retrieval
from affinis.shipping import ship

from .common import main

LOG = logging.getLogger("text_splits")
KEYS = {"folds", "seed", "labels"}


def named(documents: DataFrame) -> DataFrame:
    """The different doc_id, lang, source, key of keyed()."""
    text = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+", " "))
    return documents.select("doc_id", "lang", "source", F.md5(F.encode(text, "utf-8")).alias("key")).distinct()


def keyed(documents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, source, key, first: key names the text, A-Z lower-cased, with single spaces; first marks the smallest doc_id of a key, a null one where there is no other. A null text is an empty one; of repeated rows one stays."""
    rows = named(documents) if rows is None else rows
    # The smallest of a key is combined at the map side and joined back: a text that many share is no hot group.
    least = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "key").withColumn("first", F.col("doc_id").eqNullSafe(F.col("least"))).drop("least")


def splits(documents: DataFrame, labels: DataFrame, config: dict, rows: DataFrame | None = None) -> DataFrame:
    """keyed() with fold and the wanted labels. Groups go by size to the smallest fold; the digest of the seed and the key decides between equal ones. A document with several labels has the largest; without one it has null.

    rows: named() of the documents, where the caller keeps it, as it is read several times.
    """
    rows = keyed(documents, rows)
    dealt = retrieval.folds_by_size(rows, "key", config["folds"], config["seed"], order=ranking.draw("key", config["seed"]))
    given = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in config["labels"]])
    return dealt.join(given, "doc_id", "left").select("doc_id", "lang", "source", "key", "first", *config["labels"], "fold")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> DataFrame:
    """Writes splits and report, each replacing the last run's, and returns the splits read back. A key in two folds, or a document that is not written, is an error."""
    ship(spark)
    docs = spark.read.parquet(documents)
    # Texts are read once; what is made of them, without the text, is kept on the executors' disks while folds are dealt.
    rows = named(docs).persist(StorageLevel.DISK_ONLY)
    try:
        made = splits(docs, spark.read.parquet(labels), config, rows)
        made.write.mode("overwrite").partitionBy("fold").parquet(f"{out}/splits")
    finally:
        rows.unpersist()
    back = spark.read.schema(made.schema).parquet(f"{out}/splits")
    if leaks := metrics.in_several_folds(back, "key", "fold").limit(5).collect():
        raise ValueError(f"keys in several folds: {[r[0] for r in leaks]}")
    asked = docs.select("doc_id").distinct()
    if lost := asked.join(back.select("doc_id").distinct(), asked["doc_id"].eqNullSafe(back["doc_id"]), "left_anti").limit(5).collect():
        raise ValueError(f"documents without a fold: {[r[0] for r in lost]}")
    report = back.groupBy("fold", "lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if("first").alias("texts"), *[F.count(c).alias(f"with_{c}") for c in config["labels"]], *[F.avg(c).alias(f"share_{c}") for c in config["labels"]])
    report.orderBy("fold", "lang").coalesce(1).write.mode("overwrite").json(f"{out}/report")
    LOG.info("read %d documents of %s; wrote %d rows in %d folds to %s", docs.count(), documents, back.count(), config["folds"], out)
    return back


if __name__ == "__main__":
    main("text_splits", ["documents", "labels", "out"], KEYS, run)
