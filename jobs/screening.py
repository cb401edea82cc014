"""Screening of new spectra: each query's candidates in a narrow mass window, or a wide one where that is empty.

    python -m jobs.screening --config jobs/screening.json --queries PATH --library PATH --out PATH

PATH/rows gets the candidates, a folder for each batch of new input and each channel; PATH/checkpoint says what was taken. A run takes the files that came since the last one.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import joins
from affinis.shipping import ship

from .common import main

LOG = logging.getLogger("screening")
KEYS = {"query", "library", "narrow_ppm", "wide_ppm", "top"}
CHANNELS = ("narrow", "wide", "none")


def screened(queries: DataFrame, library: DataFrame, config: dict) -> DataFrame:
    """The ids of each query, mass, candidate, source, candidate_mass, ppm, mass_rank, channel.

    A query is a row with its ids and mass; equal ones that come together count once. Of its candidates the `top` nearest are ranked, the smaller id first of equals. One without candidates, or whose mass is null, not a number or not
    positive, has one row of channel none, so that what is found can be put in proportion to what was asked.
    """
    q, c = config["query"], config["library"]
    asked = queries.select(F.struct(*q["id"]).alias("qid"), F.expr(q["mass"]).cast("double").alias("mass")).distinct()
    known = library.select(F.col(c["id"]).alias("cid"), F.col(c["source"]).alias("source"), F.expr(c["mass"]).cast("double").alias("mass"))
    # Rows of one id with different masses are queries of their own.
    asked = asked.select(F.struct("qid", "mass").alias("query"), "mass")
    # A query is its ids and mass, so what is near goes by the mass alone.
    near = lambda q, c: joins.widened(q.withColumn("at", F.col("mass")), c, config["narrow_ppm"], config["wide_ppm"], query="at")
    pairs = joins.nearest_in(asked, known, config["top"], near, query=None)
    found = pairs.select("query", F.col("cid").alias("candidate"), "source", F.col("mass").alias("candidate_mass"), joins.ppm_error(F.col("query_mass"), F.col("mass")).alias("ppm"), F.col("mass_rank").cast("int").alias("mass_rank"), F.when(F.col("fallback"), "wide").otherwise("narrow").alias("channel"))
    bare = asked.select("query").join(found.select("query").distinct(), "query", "left_anti").withColumn("channel", F.lit("none"))
    return found.unionByName(bare, allowMissingColumns=True).select("query.qid.*", "query.mass", "candidate", "source", "candidate_mass", "ppm", "mass_rank", "channel")


def streamed(path: str) -> str:
    """The path as a pattern that only it fits: a stream reads a folder or a pattern, and so a single file too."""
    path = path.rstrip("/")
    return path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, queries: str, library: str, out: str, config: dict) -> DataFrame:
    """Takes the files of queries (Parquet) that the checkpoint does not know, and returns all rows written so far, with batch and channel.

    A batch goes to a folder of its own and replaces what is there, so a batch that was cut off and is taken again leaves the same rows. Settings of the session stay as they are.
    """
    ship(spark)
    known = spark.read.parquet(library)
    news = spark.readStream.schema(spark.read.parquet(queries).schema).parquet(streamed(queries))
    plain = screened(spark.createDataFrame([], news.schema), known, config)
    rows = f"{out}/rows"
    schema = plain.drop("channel").schema.add("batch", "long").add("channel", "string")
    # The folder is there even if nothing ever comes.
    plain.limit(0).withColumn("batch", F.lit(0).cast("long")).write.mode("append").partitionBy("batch", "channel").parquet(rows)

    def take(batch: DataFrame, number: int) -> None:
        found = screened(batch, known, config).withColumn("batch", F.lit(number).cast("long"))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "channel").parquet(rows)
        at = spark.read.schema(schema).parquet(rows).filter(F.col("batch") == number).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("mass_rank") == 1) | F.col("mass_rank").isNull()).alias("queries"))
        n = {r.channel: (r.n, r.queries) for r in at.collect()}
        wrote = ", ".join(f"{n.get(c, (0, 0))[0]} {c}" for c in CHANNELS)
        LOG.info("batch %d: read %d queries of %s; wrote rows: %s, to %s", number, sum(q for _, q in n.values()), queries, wrote, rows)

    stream = news.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    LOG.info("%s: %d batches in this run", out, sum(p.numInputRows > 0 for p in stream.recentProgress))
    return spark.read.schema(schema).parquet(rows)


if __name__ == "__main__":
    main("screening", ["queries", "library", "out"], KEYS, run)
