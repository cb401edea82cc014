"""The jobs as queries over the test tables: each runs twice into one new folder and gives what is there then."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.store import scratch

from . import screening, text_splits
from .common import config_of

_HERE = Path(__file__).resolve().parent


def job1_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as queries by unit price against parts by retail price; the second run finds nothing new."""
    out, config = scratch(spark), config_of(f"{_HERE}/screening.json", screening.KEYS)
    for _ in range(2):
        rows = screening.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet", out, config)
    return rows.select("l_orderkey", "l_linenumber", F.round("mass", 6).alias("mass"), "candidate", "source", "candidate_mass", F.round("ppm", 6).alias("ppm"), "mass_rank", "channel")


def job2_text_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in five folds by their texts, with their labels."""
    out, config = scratch(spark), config_of(f"{_HERE}/text_splits.json", text_splits.KEYS)
    for _ in range(2):
        rows = text_splits.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, config)
    return rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_screening, job2_text_splits)}

ORACLE_SQL: dict[str, str] = {
    "job1_screening": """
        WITH q AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS mass FROM lineitem),
        p AS (SELECT q.*, p_partkey AS candidate, p_brand AS source, p_retailprice AS candidate_mass, abs(p_retailprice - q.mass) <= q.mass * 20 * 1e-6 AS inside FROM q JOIN part ON q.mass > 0 AND p_retailprice > 0 AND p_retailprice BETWEEN q.mass - q.mass * 1000 * 1e-6 AND q.mass + q.mass * 1000 * 1e-6),
        s AS (SELECT *, max(inside::INT) OVER (PARTITION BY l_orderkey, l_linenumber, mass) AS any_in FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, mass ORDER BY abs(candidate_mass - mass), candidate)::INTEGER AS mass_rank FROM s WHERE inside OR any_in = 0)
        SELECT q.l_orderkey, q.l_linenumber, round(q.mass, 6) AS mass, candidate, source, candidate_mass, round(1e6 * (q.mass - candidate_mass) / candidate_mass, 6) AS ppm, mass_rank, CASE WHEN candidate IS NULL THEN 'none' WHEN any_in = 1 THEN 'narrow' ELSE 'wide' END AS channel
        FROM q LEFT JOIN r ON q.l_orderkey = r.l_orderkey AND q.l_linenumber = r.l_linenumber AND q.mass = r.mass AND r.mass_rank <= 25
    """,
    "job2_text_splits": r"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT doc_id, lang, source, md5(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS key FROM documents),
        s AS MATERIALIZED (SELECT key, count(*) AS n, min(doc_id) AS least, substr(md5('7:' || key), 1, 16) AS h FROM d GROUP BY key),
        g AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n DESC, h, key) AS i FROM s),
        r(i, loads, n, took) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0::BIGINT, 0::BIGINT UNION ALL
            SELECT g.i, list_transform(r.loads, lambda x, k: x + CASE WHEN k = list_position(r.loads, list_min(r.loads)) THEN g.n ELSE 0 END), g.n, list_position(r.loads, list_min(r.loads))::BIGINT FROM r JOIN g ON g.i = r.i + 1),
        e AS (SELECT n, list_transform(range(1, 6), lambda f: len(list_filter(list(took), lambda t: t <= f))) AS ends FROM r WHERE i > 0 GROUP BY n),
        p AS (SELECT s.key, least, len(list_filter(ends, lambda x: x <= place)) AS fold FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY h, key) - 1 AS place FROM s) s JOIN e ON e.n = s.n),
        l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
        SELECT d.doc_id, lang, source, d.key, (d.doc_id IS NOT DISTINCT FROM least) AS first, quality, toxic, fold::SMALLINT AS fold FROM d JOIN p ON p.key = d.key LEFT JOIN l ON l.doc_id = d.doc_id
    """,
}
