"""One query for each operator over the test tables, which stand in for spectra: see the docstrings for who plays whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mass
from ..operators import evidence, joins, kernels, matching, metrics, ranking
from ..sources import tables
from ..store import settled
from . import spectral_sql as sql
from .registry import query

_QUERIES = "(SELECT l_orderkey * 100 + l_linenumber AS qid, l_extendedprice / l_quantity AS mass, l_returnflag AS flag, l_shipdate AS shipped FROM lineitem WHERE l_quantity > 0)"
_LIBRARY = "(SELECT p_partkey AS cid, p_retailprice AS mass, p_type AS formula, p_brand AS source, p_size AS size FROM part)"
_CANDIDATES = "(SELECT o_custkey AS query, l_partkey AS key, round(sum(l_extendedprice), 2) AS s1, sum(l_quantity) AS s2, max(l_tax) AS s3, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)"
_HITS = "(SELECT l_suppkey AS molecule, l_returnflag AS key, l_orderkey % 7 AS spectrum, l_discount * 10 AS score, l_orderkey AS library FROM lineitem)"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY s1 DESC, key) AS rank FROM {_CANDIDATES})"
_CHANNELS = f"(SELECT query, 'a' AS channel, key, s1 AS channel_score, row_number() OVER (PARTITION BY query ORDER BY s1 DESC, key) AS rank FROM {_CANDIDATES} UNION ALL SELECT query, 'b', key, s2, row_number() OVER (PARTITION BY query ORDER BY s2 DESC, key) FROM {_CANDIDATES} UNION ALL SELECT query, 'c', key, s3, row_number() OVER (PARTITION BY query ORDER BY s3 DESC, key) FROM {_CANDIDATES} WHERE n > 1 OR key % 3 = 0)"
#: A number from 1 to 200 is each customer's truth, and candidates count modulo 200; customers with few candidates miss it.
_TRUTH = "(SELECT c_custkey AS query, c_mktsegment AS segment, c_nationkey % 20 AS nation, 1 + c_custkey * 7 % 200 AS truth, c_custkey % 4 > 0 AS present FROM customer)"
_RANKS = f"(SELECT t.*, r.rank FROM {_TRUTH} t LEFT JOIN (SELECT query, min(rank) AS rank, key % 200 AS key FROM {_RANKED} GROUP BY query, key % 200) r ON t.query = r.query AND t.truth = r.key)"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").filter("l_quantity > 0").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("qid"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("mass"), F.col("l_returnflag").alias("flag"))


def library_of(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("cid"), F.col("p_retailprice").alias("mass"), F.col("p_type").alias("formula"), F.col("p_brand").alias("source"), F.col("p_size").alias("size"))


def candidates_of(spark: SparkSession, d: str, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """A customer's parts with sums of their lines, dealt by `by` once, before they are added up; what ranks them inside a query stays there."""
    lines = t(spark, d, "lineitem")
    rows = lines.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query"), F.col("l_partkey").alias("key"), "l_extendedprice", "l_quantity", "l_tax")
    rows = ranking.dealt(rows, lines.count(), *by)
    return rows.groupBy("query", "key").agg(F.round(F.sum("l_extendedprice"), 2).alias("s1"), F.sum("l_quantity").alias("s2"), F.max("l_tax").alias("s3"), F.count(F.lit(1)).alias("n"))


def hits_of(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("molecule"), F.col("l_returnflag").alias("key"), (F.col("l_orderkey") % 7).alias("spectrum"), (F.col("l_discount") * 10).alias("score"), F.col("l_orderkey").alias("library"))


def ranked_of(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(candidates_of(spark, d), ["query"], F.col("s1").desc(), F.col("key"))


def channels_of(spark: SparkSession, d: str) -> DataFrame:
    """Three rankings of the candidates, of one aggregate and one partitioning by query; the third has only some of them."""
    c = candidates_of(spark, d).withColumn("third", (F.col("n") > 1) | (F.col("key") % 3 == 0))
    rank = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    c = c.withColumn("ra", rank(F.col("s1").desc(), "key")).withColumn("rb", rank(F.col("s2").desc(), "key")).withColumn("rc", rank(F.col("third").desc(), F.col("s3").desc(), "key"))
    part = lambda name, s, r: F.struct(F.lit(name).alias("channel"), F.col(s).cast("double").alias("channel_score"), F.col(r).alias("rank"))
    parts = F.concat(F.array(part("a", "s1", "ra"), part("b", "s2", "rb")), F.when(F.col("third"), F.array(part("c", "s3", "rc"))).otherwise(F.expr("cast(array() as array<struct<channel:string,channel_score:double,rank:int>>)")))
    return c.select("query", "key", F.explode(parts).alias("x")).select("query", "x.channel", "key", "x.channel_score", "x.rank")


def truth_of(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").selectExpr("c_custkey AS query", "c_mktsegment AS segment", "c_nationkey % 20 AS nation", "1 + c_custkey * 7 % 200 AS truth", "c_custkey % 4 > 0 AS present")


def ranks_of(spark: SparkSession, d: str) -> DataFrame:
    return metrics.truth_ranks(truth_of(spark, d), ranked_of(spark, d).select("query", (F.col("key") % 200).alias("key"), "rank"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


_PPM = "abs(c.mass - q.mass) <= q.mass * {0} * 1e-6"


@query(f"""SELECT qid, cid, mass_rank, round(1e6 * (query_mass - mass) / mass, 6) AS ppm FROM (SELECT q.qid, c.cid, q.mass AS query_mass, c.mass, CAST(row_number() OVER (PARTITION BY qid ORDER BY abs(c.mass - q.mass), cid) AS INTEGER) AS mass_rank
    FROM {_QUERIES} q JOIN {_LIBRARY} c ON c.mass BETWEEN q.mass - q.mass * 20.0 * 1e-6 AND q.mass + q.mass * 20.0 * 1e-6) WHERE mass_rank <= 10""")
def mass_window_topk(spark, d):
    """J1, C3, W11. Unit prices are query masses, retail prices candidate masses."""
    pairs = joins.nearest_in(queries_of(spark, d).select("qid", "mass"), library_of(spark, d).select("cid", "mass"), 10, lambda q, c: joins.mass_window(q, c, 20.0))
    return pairs.select("qid", "cid", "mass_rank", r6(joins.ppm_error(F.col("query_mass"), F.col("mass")), "ppm"))


@query(f"SELECT CAST(source AS VARCHAR) AS source, count(*) AS pairs FROM {_QUERIES} q JOIN {_LIBRARY} c ON c.mass BETWEEN q.mass - 0.05 AND q.mass + 0.05 GROUP BY source")
def da_window_counts(spark, d):
    """J3."""
    return joins.da_window(queries_of(spark, d), library_of(spark, d), 0.05).groupBy("source").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"SELECT q.qid, c.cid, CASE WHEN {_PPM.format(20)} THEN 20.0 WHEN {_PPM.format(50)} THEN 50.0 ELSE 100.0 END::DOUBLE AS least_ppm, (CASE WHEN {_PPM.format(20)} THEN 3 WHEN {_PPM.format(50)} THEN 2 ELSE 1 END)::INTEGER AS n_tolerances FROM {_QUERIES} q JOIN {_LIBRARY} c ON {_PPM.format(100)}")
def mass_channels(spark, d):
    """One join, all tolerances that hold."""
    return joins.channels(queries_of(spark, d).select("qid", "mass"), library_of(spark, d).select("cid", "mass"), [20.0, 50.0, 100.0]).select("qid", "cid", "least_ppm", F.size("tolerances").alias("n_tolerances"))


@query(f"""SELECT qid, cid, least_ppm FROM (SELECT q.qid, q.mass, c.cid, CASE WHEN {_PPM.format(20)} THEN 20.0 WHEN {_PPM.format(50)} THEN 50.0 ELSE 100.0 END::DOUBLE AS least_ppm, row_number() OVER (PARTITION BY q.qid ORDER BY abs(c.mass - q.mass), c.cid) AS r FROM (SELECT DISTINCT ON (qid) * FROM {_QUERIES} ORDER BY qid, mass) q JOIN {_LIBRARY} c ON {_PPM.format(100)}) WHERE r <= 2""")
def limited_channels(spark, d):
    """Of all channels together the two nearest of each query; of line items of one number the cheapest."""
    q = queries_of(spark, d).groupBy("qid").agg(F.min("mass").alias("mass"))
    return joins.channels(q, library_of(spark, d).select("cid", "mass"), [20.0, 50.0, 100.0], limit=2).select("qid", "cid", "least_ppm")


@query(f"""WITH p AS (SELECT q.qid, c.cid, abs(c.mass - q.mass) <= q.mass * 5 * 1e-6 AS inside FROM {_QUERIES} q JOIN {_LIBRARY} c ON c.mass BETWEEN q.mass - q.mass * 40 * 1e-6 AND q.mass + q.mass * 40 * 1e-6),
    a AS (SELECT *, max(inside) OVER (PARTITION BY qid) AS found FROM p) SELECT qid, cid, NOT found AS fallback FROM a WHERE inside OR NOT found""")
def wider_fallback(spark, d):
    """J6."""
    return joins.widened(queries_of(spark, d).select("qid", "mass"), library_of(spark, d).select("cid", "mass"), 5.0, 40.0).select("qid", "cid", "fallback")


@query(f"""WITH l AS (SELECT cid, mass, row_number() OVER (ORDER BY mass, cid) - 1 AS place FROM {_LIBRARY}), m AS (SELECT count(*) AS n FROM l),
    q AS (SELECT p_partkey AS qid, p_retailprice + 0.003 AS mass FROM part), c AS (SELECT q.qid, q.mass, count(l.cid) AS centre FROM q LEFT JOIN l ON l.mass < q.mass GROUP BY q.qid, q.mass)
    SELECT c.qid, l.cid FROM c, m, l WHERE l.place >= greatest(0, least(n - 6, centre - 3)) AND l.place < greatest(0, least(n - 6, centre - 3)) + 6""")
def nearest_fallback(spark, d):
    """Six neighbours by place in the order of mass."""
    q = t(spark, d, "part").select(F.col("p_partkey").alias("qid"), (F.col("p_retailprice") + 0.003).alias("mass"))
    return joins.nearest_positions(q, library_of(spark, d).select("cid", "mass"), 6).select("qid", "cid")


@query("SELECT a.p_partkey AS qid, b.p_partkey AS cid FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND b.p_retailprice BETWEEN a.p_retailprice * (1 - 5000e-6) AND a.p_retailprice * (1 + 5000e-6)")
def formula_lookup(spark, d):
    """Equal formula and near mass, the query itself excluded."""
    a = library_of(spark, d).select(F.col("cid").alias("qid"), F.col("mass").alias("query_mass"), "formula")
    b = library_of(spark, d).select("cid", "mass", "formula")
    pairs = joins.formula_near(a, b, F.col("query_mass") * (1 - 5000e-6), F.col("query_mass") * (1 + 5000e-6))
    return pairs.filter(F.col("qid") != F.col("cid")).select("qid", "cid")


@query(f"SELECT c.query, c.key FROM {_CANDIDATES} c WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = c.query AND l.l_partkey = c.key AND l.l_returnflag = 'R')")
def anti_exclusion(spark, d):
    """Candidates without those that were returned."""
    out = t(spark, d, "lineitem").filter("l_returnflag = 'R'").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query"), F.col("l_partkey").alias("key")).distinct()
    return joins.without(candidates_of(spark, d), out, ["query", "key"]).select("query", "key")


@query("""WITH p AS (SELECT o_custkey AS qid, o_orderkey AS cid, CASE WHEN o_custkey % 5 > 0 AND o_orderkey % 3 > 0 THEN o_orderstatus END = 'F' AS same FROM orders), a AS (SELECT *, max(coalesce(same, false)) OVER (PARTITION BY qid) AS found FROM p) SELECT qid, cid FROM a WHERE same OR NOT found""")
def polarity_fallback(spark, d):
    """An order's status is its polarity, unknown for all orders of a fifth of the customers and for some of the others."""
    known = F.when((F.col("o_custkey") % 5 > 0) & (F.col("o_orderkey") % 3 > 0), F.col("o_orderstatus"))
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("cid"), known.alias("mode"))
    return joins.same_or_any(rows, F.col("mode") == "F").select("qid", "cid")


@query("SELECT CASE WHEN o_orderstatus = 'O' THEN 'o' WHEN o_orderpriority LIKE '%M' THEN 'negative' WHEN o_orderpriority LIKE '%T' THEN 'positive' ELSE 'unknown' END AS polarity, count(*) AS n FROM orders GROUP BY 1")
def polarity_rule(spark, d):
    """Mode, else the adduct's sign, else unknown."""
    sign = F.regexp_replace(F.regexp_replace("o_orderpriority", "M$", "-"), "T$", "+")
    p = joins.polarity(F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus")), sign)
    return t(spark, d, "orders").groupBy(p.alias("polarity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, coalesce(b.brand, p_brand) AS p_brand FROM part LEFT JOIN (SELECT p_partkey AS k, upper(p_type) AS brand FROM part WHERE p_partkey % 9 = 0) b ON p_partkey = k")
def coalesce_update(spark, d):
    """J13, P8."""
    part = t(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return joins.updated(part.drop("p_type"), part.filter("p_partkey % 9 = 0").select("p_partkey", F.upper("p_type").alias("p_brand")), "p_partkey", ["p_brand"])


def _evidence(method: str):
    def run(spark, d):
        return evidence.aggregated(hits_of(spark, d), ["molecule", "key"], method).select("molecule", "key", r6(F.col("evidence"), "evidence"))

    run.__name__ = f"evidence_{method}"
    run.__doc__ = "G1 to G6: discounts of a supplier's lines are scores, flags candidates, orders mod 7 spectra."
    return run


_CLIP = f"(SELECT molecule, key, spectrum, least(1.0, greatest(0.0, score)) AS s FROM {_HITS})"
query(f"SELECT molecule, key, round(max(s), 6) AS evidence FROM {_CLIP} GROUP BY ALL")(_evidence("max"))
query(f"SELECT molecule, key, round(avg(s), 6) AS evidence FROM {_CLIP} GROUP BY ALL")(_evidence("mean"))
query(f"SELECT molecule, key, round(avg(s), 6) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY molecule, key ORDER BY s DESC) AS r FROM {_CLIP}) WHERE r <= 3 GROUP BY ALL")(_evidence("topk"))
query(f"SELECT molecule, key, round(1 - product(1 - s), 6) AS evidence FROM (SELECT molecule, key, spectrum, max(s) AS s FROM {_CLIP} GROUP BY ALL) GROUP BY ALL")(_evidence("noisy_or"))
query(f"SELECT molecule, key, round(1.0 + ln(sum(exp(s - 1))), 6) AS evidence FROM {_CLIP} GROUP BY ALL")(_evidence("logsumexp"))


@query(f"SELECT molecule, key, round(max(score), 6) AS max_score, count(DISTINCT spectrum) AS spectra, count(DISTINCT library) AS libraries, min(library) AS first_library, arg_max(library, (score, -library)) AS best_library FROM {_HITS} GROUP BY ALL")
def evidence_columns(spark, d):
    """G1: what goes along with the evidence."""
    return evidence.support(hits_of(spark, d), ["molecule", "key"]).withColumn("max_score", F.round("max_score", 6))


@query("SELECT o_custkey AS molecule, round(median(o_totalprice), 6) AS mass, count(*) AS spectra, count(DISTINCT o_orderpriority) AS adducts, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS positive, round(coalesce(avg(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END), 0), 6) AS energy FROM orders GROUP BY o_custkey")
def query_context(spark, d):
    """Median mass and context of a molecule's spectra (a customer's orders); a third of the energies are no numbers."""
    o = t(spark, d, "orders").withColumn("e", F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 50).cast("double")).otherwise(float("nan"))).withColumnRenamed("o_custkey", "molecule")
    rows = evidence.context(o, "molecule", "o_totalprice", "o_orderpriority", F.col("o_orderstatus") == "F", "e")
    return rows.select("molecule", r6(F.col("mass"), "mass"), "spectra", "adducts", r6(F.col("positive"), "positive"), r6(F.col("energy"), "energy"))


@query("SELECT l_orderkey, arg_max(l_partkey, (l_quantity, -l_linenumber, l_partkey)) AS part, max(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey")
def richest_per_group(spark, d):
    """Representative of each structure, ties to the first row."""
    rows = t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), "l_linenumber")
    return evidence.richest(rows, ["l_orderkey"], "quantity", "l_linenumber").select("l_orderkey", "part", "quantity")


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1")
def mode_per_group(spark, d):
    """G18."""
    return evidence.mode(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("""WITH b AS (SELECT label, unnest(range(64))::INTEGER AS bit, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT label, bit, 1 / (1 + exp(-x)) AS p FROM b)
    SELECT label, bit, round(avg(p), 6) AS p FROM p GROUP BY ALL""")
def pooled_mean(spark, d):
    """Sigmoids of embeddings are bit probabilities."""
    rows = t(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("p"))
    return evidence.pooled(rows, "label", "p").select("label", "bit", r6(F.col("p"), "p"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE))) AS p FROM embeddings), w AS (SELECT *, list_avg(list_transform(p, lambda x: abs(x - 0.5) * 2)) AS w FROM v),
    b AS (SELECT label, w, unnest(range(64))::INTEGER AS bit, unnest(p) AS p FROM w) SELECT label, bit, round(sum(w * p) / sum(w), 6) AS p FROM b GROUP BY ALL""")
def pooled_weighted(spark, d):
    """G15, weighted by confidence."""
    rows = t(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("p"))
    return evidence.pooled(rows, "label", "p", weighted=True).select("label", "bit", r6(F.col("p"), "p"))


@query(f"SELECT query, key, CAST(rank AS INTEGER) AS rank, CAST(count(*) OVER (PARTITION BY query) AS BIGINT) AS size, round(rank / count(*) OVER (PARTITION BY query), 6) AS percentile, round((rank - 1) / greatest(count(*) OVER (PARTITION BY query) - 1, 1), 6) AS percentile_zero, round(1.0 / rank, 6) AS reciprocal, round(s1 - max(s1) OVER (PARTITION BY query), 6) AS delta FROM {_RANKED}")
def rank_forms(spark, d):
    """W1, W4, W8, W9, W10."""
    w = Window.partitionBy("query")
    n, r = F.count(F.lit(1)).over(w), F.col("rank")
    return ranked_of(spark, d).select("query", "key", "rank", n.alias("size"), r6(ranking.percentile(r, n), "percentile"), r6(ranking.percentile_from_zero(r, n), "percentile_zero"), r6(1.0 / r, "reciprocal"), r6(F.col("s1") - F.max("s1").over(w), "delta"))


@query(f"""SELECT query, key, round(CASE WHEN coalesce(stddev_samp(s2) OVER w, 0) > 0 THEN (s2 - avg(s2) OVER w) / stddev_samp(s2) OVER w ELSE 0 END, 6) AS z_sample, round(CASE WHEN stddev_pop(s2) OVER w > 0 THEN (s2 - avg(s2) OVER w) / stddev_pop(s2) OVER w ELSE 0 END, 6) AS z_population,
    round(CASE WHEN max(s2) OVER w > min(s2) OVER w THEN (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) ELSE 0 END, 6) AS min_max FROM {_CANDIDATES} WINDOW w AS (PARTITION BY query)""")
def normalisations(spark, d):
    """W5, W6, W7."""
    g = ["query"]
    return candidates_of(spark, d).select("query", "key", r6(ranking.z_score("s2", g), "z_sample"), r6(ranking.z_score("s2", g, sample=False), "z_population"), r6(ranking.min_max("s2", g), "min_max"))


@query(f"SELECT query, key, CAST(rank AS INTEGER) AS top_rank FROM {_RANKED} WHERE rank <= 5")
def top_n_per_group(spark, d):
    """W11, O3."""
    return ranking.top_n(candidates_of(spark, d), ["query"], 5, F.col("s1").desc(), F.col("key")).select("query", "key", "top_rank")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def dedup_keep_first(spark, d):
    """U2, U7."""
    return ranking.first_of(t(spark, d, "lineitem"), ["l_partkey"], F.col("l_orderkey"), F.col("l_linenumber")).select("l_partkey", "l_orderkey", "l_linenumber")


_ONCE = f"(SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY rank, key) AS nr, count(*) OVER (PARTITION BY query, channel) AS len FROM (SELECT query, channel, key % 50 AS key, min(rank) AS rank FROM {_CHANNELS} GROUP BY ALL))"


def _channels_50(spark, d):
    return channels_of(spark, d).withColumn("key", F.col("key") % 50)


def _fused(part: str) -> str:
    return f"SELECT query, key, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, seen, key) AS INTEGER) AS fused_rank FROM (SELECT query, key, sum({part}) AS score, min((channel, nr)) AS seen FROM {_ONCE} GROUP BY query, key)"


@query(_fused("(CASE channel WHEN 'a' THEN 2.0 ELSE 1.0 END) / (60 + nr)"))
def rrf(spark, d):
    """reciprocal rank fusion, deduplicated, weighted."""
    return ranking.rank_fusion(_channels_50(spark, d), "rrf", weights={"a": 2.0}).withColumn("score", F.round("score", 6))


@query(_fused("(len - nr + 1) / len"))
def borda(spark, d):
    """F2."""
    return ranking.rank_fusion(_channels_50(spark, d), "borda").withColumn("score", F.round("score", 6))


@query(f"SELECT query, key, round(sum(z), 6) AS score FROM (SELECT query, key, CASE WHEN stddev_pop(channel_score) OVER w > 0 THEN (channel_score - avg(channel_score) OVER w) / stddev_pop(channel_score) OVER w ELSE 0 END AS z FROM {_CHANNELS} WINDOW w AS (PARTITION BY query, channel)) GROUP BY ALL")
def score_fusion_z(spark, d):
    """F3 with z-scores."""
    return ranking.score_fusion(channels_of(spark, d)).withColumn("score", F.round("score", 6))


@query(f"SELECT query, key, round(sum(z * CASE channel WHEN 'b' THEN 0.5 ELSE 1.0 END), 6) AS score FROM (SELECT query, key, channel, CASE WHEN max(channel_score) OVER w > min(channel_score) OVER w THEN (channel_score - min(channel_score) OVER w) / (max(channel_score) OVER w - min(channel_score) OVER w) ELSE 0 END AS z FROM {_CHANNELS} WINDOW w AS (PARTITION BY query, channel)) GROUP BY ALL")
def score_fusion_minmax(spark, d):
    """F3 with min-max scores and weights."""
    return ranking.score_fusion(channels_of(spark, d), "minmax", {"b": 0.5}).withColumn("score", F.round("score", 6))


@query(f"SELECT query, key, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT query, channel, key % 50 AS key, min(rank) AS rank FROM {_CHANNELS} GROUP BY ALL) GROUP BY ALL")
def rrf_union_raw_rank(spark, d):
    """gaps left by duplicates stay."""
    return ranking.union_raw_rank(_channels_50(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH g AS (SELECT query, key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s2 DESC, key) AS r FROM {_CANDIDATES}) WHERE r = 1 AND s2 >= 60),
    b AS (SELECT query, key, rank, 'ranker' AS source FROM {_RANKED} UNION ALL SELECT query, key, 0, 'gate' FROM g), o AS (SELECT query, key, min((rank, source)) AS b FROM b GROUP BY ALL)
    SELECT query, key, CAST(row_number() OVER (PARTITION BY query ORDER BY b[1], key) AS INTEGER) AS rank, b[2] AS source FROM o""")
def gate_prepend(spark, d):
    """The best by quantity goes first where it has 60."""
    spectral = ranking.ranked(candidates_of(spark, d), ["query"], F.col("s2").desc(), F.col("key"))
    return ranking.gated(ranked_of(spark, d).select("query", "key", "rank"), spectral, F.col("s2") >= 60).select("query", "key", "rank", "source")


@query(f"""SELECT query, key, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS new_rank, count(*) OVER (PARTITION BY query) AS candidate_count FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s2 DESC, key) AS wide FROM {_RANKED}) WHERE n > 1 OR wide <= 3""")
def prune_fallback(spark, d):
    """U9."""
    rows = ranking.ranked(ranked_of(spark, d), ["query"], F.col("s2").desc(), F.col("key"), name="wide")
    return ranking.pruned(rows, F.col("n") > 1, "wide", 3, [F.col("rank")]).select("query", "key", "new_rank", "candidate_count")


@query(f"""SELECT query, key, CAST(row_number() OVER (PARTITION BY query ORDER BY round(f, 15) DESC, rank) AS INTEGER) AS fused_rank FROM (SELECT *, 0.9 / (60 + rank) + 0.1 / (60 + row_number() OVER (PARTITION BY query ORDER BY s2 DESC, rank)) AS f FROM {_RANKED})""")
def analog_rrf(spark, d):
    """F5, W2."""
    return ranking.analog_fusion(ranked_of(spark, d).withColumn("analog_score", F.col("s2"))).select("query", "key", "fused_rank")


@query(f"""SELECT query, key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s1 DESC, key) - 1 AS place, count(*) OVER (PARTITION BY query) AS m FROM {_CANDIDATES}) WHERE m <= 10 OR place IN (SELECT i * (m - 1) // 9 FROM range(10) r(i))""")
def linspace_sample(spark, d):
    """O5."""
    return ranking.systematic(candidates_of(spark, d), 10, ["query"], F.col("s1").desc(), F.col("key")).select("query", "key")


@query(f"SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 25 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, {', '.join(f'round(avg(CASE WHEN rank <= {c} THEN 1.0 ELSE 0 END), 6) AS hits_{c}' for c in (1, 5, 10, 25))}, median(CASE WHEN rank <= 25 THEN rank END)::DOUBLE AS median_rank, round(avg(CASE WHEN rank <= 25 THEN 0.0 ELSE 1 END), 6) AS missed FROM {_RANKS}")
def mrr_hits(spark, d):
    """Customers are queries, some without candidates."""
    m = metrics.rank_metrics(ranks_of(spark, d))
    return m.select(*[F.round(c, 6).alias(c) if c not in ("queries", "median_rank") else F.col(c) for c in m.columns])


@query(f"SELECT CAST(k AS INTEGER) AS cutoff, count(*) AS queries, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS recall FROM {_RANKS}, (SELECT unnest([1, 10, 100]) AS k) GROUP BY k")
def recall_at_k(spark, d):
    """G20."""
    return metrics.recall(ranks_of(spark, d), [1, 10, 100]).select("cutoff", "queries", r6(F.col("recall"), "recall"))


@query(f"SELECT stratum, level, 25 AS cutoff, count(*) AS queries, round(avg(CASE WHEN rank <= 25 THEN 1.0 ELSE 0 END), 6) AS recall FROM (SELECT 'segment' AS stratum, coalesce(segment, 'unknown') AS level, rank FROM {_RANKS} UNION ALL SELECT 'nation', coalesce(nation::VARCHAR, 'unknown'), rank FROM {_RANKS}) GROUP BY stratum, level")
def stratified_recall(spark, d):
    """G22."""
    return metrics.stratified(ranks_of(spark, d), ["segment", "nation"], [25]).select("stratum", "level", "cutoff", "queries", r6(F.col("recall"), "recall"))


@query(f"SELECT CASE WHEN NOT present THEN 'absent' WHEN rank IS NULL THEN 'missed' WHEN rank > 25 THEN 'below_25' ELSE 'hit' END AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM {_RANKS} GROUP BY 1")
def failure_taxonomy(spark, d):
    """G24."""
    counts = metrics.failures(ranks_of(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("category", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), "share"))


@query("SELECT h::DOUBLE AS threshold, coalesce(sum((l_discount >= h)::INT), 0)::BIGINT AS n, round(avg((l_discount >= h)::INT), 6) AS coverage, round(sum((l_discount >= h AND l_returnflag = 'R')::INT) / nullif(sum((l_discount >= h)::INT), 0), 6) AS precision FROM lineitem, (SELECT unnest([0.0, 0.02, 0.05, 0.08, 0.5]) AS h) GROUP BY h")
def threshold_sweep(spark, d):
    """G25."""
    rows = t(spark, d, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").alias("ok"))
    m = metrics.threshold_sweep(rows, "l_discount", "ok", [0.0, 0.02, 0.05, 0.08, 0.5])
    return m.select("threshold", "n", r6(F.col("coverage"), "coverage"), r6(F.col("precision"), "precision"))


@query("SELECT c AS \"column\", sum((v IS NULL)::INT)::BIGINT AS nulls, count(DISTINCT v) AS n_distinct, count(*) AS n_rows FROM (SELECT 'o_custkey' AS c, o_custkey::VARCHAR AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY c")
def profile_nulls(spark, d):
    """R8, G10, and of G11 the distinct values."""
    return metrics.profile(t(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def frequency(spark, d):
    """How often each value comes."""
    return metrics.frequencies(t(spark, d, "events"), "event_type")


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS folds FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def leakage_check(spark, d):
    """F14."""
    return metrics.in_several_folds(t(spark, d, "orders").withColumn("fold", F.col("o_orderkey") % 3), "o_custkey", "fold")


@query("SELECT label, round((sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (count(*) - sum(pos))), 6) AS auroc FROM (SELECT l_returnflag AS label, (l_tax > 0.04)::INT AS pos, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS r FROM lineitem) GROUP BY label")
def bit_auroc(spark, d):
    """G27, areas."""
    rows = t(spark, d, "lineitem").withColumn("label", F.col("l_returnflag"))
    return metrics.auroc(rows, ["label"], "l_discount", F.col("l_tax") > 0.04).select("label", r6(F.col("auroc"), "auroc"))


@query(f"SELECT query AS molecule_id, string_agg('P' || key, ';' ORDER BY rank) AS smiles FROM {_RANKED} WHERE rank <= 25 GROUP BY query")
def submission_strings(spark, d):
    """F15, G16, G17."""
    rows = ranked_of(spark, d).select(F.col("query").alias("molecule_id"), "rank", F.concat(F.lit("P"), F.col("key").cast("string")).alias("smiles"), F.col("key").alias("inchikey14"))
    return tables.submission(rows)


@query(f"""WITH s AS (SELECT query AS molecule_id, string_agg('P' || key, ';' ORDER BY rank) AS smiles FROM {_RANKED} WHERE rank <= 25 GROUP BY query),
    b AS (SELECT molecule_id, CASE molecule_id % 5 WHEN 0 THEN smiles || ';' || split_part(smiles, ';', 1) WHEN 1 THEN smiles || '; ' WHEN 2 THEN NULL ELSE smiles END AS smiles FROM s WHERE molecule_id % 7 > 0 UNION ALL SELECT -1, 'P1' UNION ALL SELECT molecule_id, smiles FROM s WHERE molecule_id % 7 = 1)
    SELECT molecule_id, CASE WHEN smiles IS NULL OR list_contains(list_transform(string_split(smiles, ';'), lambda x: trim(x)), '') THEN 'blank' WHEN len(string_split(smiles, ';')) > 25 THEN 'too_many' ELSE 'repeated_structure' END AS fault FROM b
    WHERE smiles IS NULL OR list_contains(list_transform(string_split(smiles, ';'), lambda x: trim(x)), '') OR len(string_split(smiles, ';')) > 25 OR len(list_distinct(string_split(smiles, ';'))) < len(string_split(smiles, ';'))
    UNION ALL SELECT molecule_id, 'missing' FROM s WHERE molecule_id % 7 = 0 UNION ALL SELECT -1, 'unknown' UNION ALL SELECT molecule_id, 'repeated_id' FROM b GROUP BY molecule_id HAVING count(*) > 1""")
def submission_faults(spark, d):
    """What is wrong with a submission whose ids are missing, unknown and repeated, and whose lists repeat, are blank or too long."""
    rows = ranked_of(spark, d).select(F.col("query").alias("molecule_id"), "rank", F.concat(F.lit("P"), F.col("key").cast("string")).alias("smiles"), F.col("key").alias("inchikey14"))
    good = settled(tables.submission(rows))  # read for each fault
    kind = F.col("molecule_id") % 5
    text = F.when(kind == 0, F.concat_ws(";", "smiles", F.substring_index("smiles", ";", 1))).when(kind == 1, F.concat("smiles", F.lit("; "))).when(kind == 2, F.lit(None)).otherwise(F.col("smiles"))
    bad = good.filter("molecule_id % 7 > 0").withColumn("smiles", text).unionByName(good.filter("molecule_id % 7 = 1")).unionByName(good.limit(1).select(F.lit(-1).cast("long").alias("molecule_id"), F.lit("P1").alias("smiles")))
    return tables.check_submission(bad, good.select("molecule_id"))


@query("SELECT vec_id, other, round(CASE WHEN u > 0 THEN i / u ELSE 1 END, 6) AS tanimoto FROM (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k] > 0 AND b.embedding[k] > 0)::INT)) AS i, list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k] > 0 OR b.embedding[k] > 0)::INT)) AS u FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def tanimoto(spark, d):
    """Signs of embeddings are bits."""
    e = t(spark, d, "embeddings").select("vec_id", kernels.packed(F.transform("embedding", lambda x: x > 0)).alias("w"))
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("w").alias("v"))
    return e.join(o, "vec_id").select("vec_id", "other", r6(kernels.tanimoto(F.col("w"), F.col("v")), "tanimoto"))


@query("""WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: 1 / (1 + exp(-x::DOUBLE))) AS p, list_transform(b.embedding, lambda x: (x > 0)::INT) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    r AS (SELECT vec_id, unnest(p) AS p, unnest(b) AS b FROM p) SELECT vec_id, round(sum(p * b), 6) AS soft, round(sum(p * b) / (sum(p) + sum(b) - sum(p * b)), 6) AS expected, round(sum((p >= 0.5 AND b = 1)::INT) / sum((p >= 0.5 OR b = 1)::INT), 6) AS hard,
    round(CASE WHEN sum(b) > 0 THEN sum(p * b) / (sqrt(sum(p * p)) * sqrt(sum(b))) ELSE 0 END, 6) AS cosine, round(-avg(b * ln(p) + (1 - b) * ln(1 - p)), 6) AS bce FROM r GROUP BY vec_id""")
def compat_features(spark, d):
    """A13."""
    e = t(spark, d, "embeddings")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("b"))
    rows = e.select("vec_id", F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("p")).join(o, "vec_id").select("vec_id", kernels.compatibility(F.col("p"), F.col("b")).alias("c"))
    return rows.select("vec_id", r6(F.col("c.soft_intersection"), "soft"), r6(F.col("c.expected_tanimoto"), "expected"), r6(F.col("c.binary_tanimoto"), "hard"), r6(F.col("c.cosine"), "cosine"), r6(F.col("c.bce"), "bce"))


def spectra_of(spark: SparkSession, d: str) -> DataFrame:
    """Orders are spectra: line prices over 100 are m/z, quantities intensities, the dearest line sets the precursor."""
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(kernels.peak(F.round(F.col("l_extendedprice") / 100, 2), F.col("l_quantity")))).alias("peaks"))
    return rows.withColumn("precursor", F.array_max(F.transform("peaks", lambda p: p["mz"])) + 1)


def spectrum_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each order and a customer's next one."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = t(spark, d, "orders").select(F.col("o_orderkey").alias("a"), after.alias("b")).filter("b is not null")
    s = spectra_of(spark, d)
    return pairs.join(s.select(F.col("l_orderkey").alias("a"), F.col("peaks").alias("q"), F.col("precursor").alias("qp")), "a").join(s.select(F.col("l_orderkey").alias("b"), F.col("peaks").alias("r"), F.col("precursor").alias("rp")), "b")


@query("""WITH p AS (SELECT l_orderkey, round(l_extendedprice / 100, 2) AS mz, sqrt(l_quantity) AS i, l_quantity AS l FROM lineitem) SELECT l_orderkey, count(*)::INTEGER AS peaks, round(sum(i / m), 6) AS total FROM (SELECT *, max(i) OVER (PARTITION BY l_orderkey) AS m, max(l) OVER (PARTITION BY l_orderkey) AS q FROM p) WHERE l >= 0.2 * q GROUP BY l_orderkey""")
def clean_spectrum(spark, d):
    """A1, A2, S17."""
    peaks = kernels.cleaned(F.col("peaks"), F.col("precursor"), 0.2, 50)
    return spectra_of(spark, d).select("l_orderkey", peaks.alias("p")).select("l_orderkey", F.size("p").alias("peaks"), r6(kernels.total(F.col("p"), lambda x: x["intensity"]), "total"))


@query(f"SELECT a, b, round(direct, 6) AS direct, matched, round(explained, 6) AS explained, round(modified, 6) AS modified, round(loss, 6) AS loss, round(score, 6) AS score FROM {sql.cosines(sql.PAIRS, 5, 'a, b')}")
def spectrum_cosines(spark, d):
    """Direct, modified and neutral-loss cosine of spectrum pairs, tolerance 5."""
    rows = matching.with_cosines(spectrum_pairs(spark, d), 5.0, "q", "r", "qp", "rp")
    return rows.select("a", "b", r6(F.col("direct"), "direct"), "matched", r6(F.col("explained"), "explained"), r6(F.col("modified"), "modified"), r6(F.col("loss"), "loss"), r6(kernels.hit_score(F.col("direct"), F.col("modified"), F.col("loss")), "score"))


_WEIGHTED = sql.weighted_rows(sql.weighted_rows(sql.PAIRS, "q", "a, b, r, qp, rp", "q"), "r", "a, b, q, qp, rp", "r")


@query(f"SELECT a, b, round(CASE WHEN abs(qp - rp) > 0.001 THEN greatest({sql.similarity('q', 'r', 5, '0')}, {sql.similarity('q', 'r', 5, '(qp - rp)')}) ELSE {sql.similarity('q', 'r', 5, '0')} END, 6) AS similarity FROM {_WEIGHTED}")
def entropy_similarity(spark, d):
    """A9 to A11."""
    q, r = kernels.entropy_weighted(F.col("q")), kernels.entropy_weighted(F.col("r"))
    rows = spectrum_pairs(spark, d).select("a", "b", q.alias("q"), r.alias("r"), (F.col("qp") - F.col("rp")).alias("shift"))
    return matching.with_entropy(rows, 5.0, "shift").select("a", "b", r6(F.col("similarity"), "similarity"))


@query("""WITH s AS (SELECT l_orderkey AS k, floor(round(l_extendedprice / 100, 2) / 50)::INT AS b, max(l_quantity) AS i FROM lineitem WHERE floor(round(l_extendedprice / 100, 2) / 50) < 20 GROUP BY ALL), n AS (SELECT k, sqrt(sum(i * i)) AS n FROM s GROUP BY k),
    p AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders), g AS (SELECT p.a, p.b FROM p WHERE p.a IN (SELECT l_orderkey FROM lineitem) AND p.b IN (SELECT l_orderkey FROM lineitem)),
    x AS (SELECT g.a, g.b, sum(s.i * u.i) AS dot FROM g JOIN s ON s.k = g.a JOIN s u ON u.k = g.b AND u.b = s.b GROUP BY ALL)
    SELECT g.a, g.b, round(coalesce(x.dot / (na.n * nb.n), 0), 6) AS cosine FROM g LEFT JOIN x ON x.a = g.a AND x.b = g.b LEFT JOIN n na ON na.k = g.a LEFT JOIN n nb ON nb.k = g.b""")
def binned_cosine(spark, d):
    """A8, with the maximum."""
    rows = spectrum_pairs(spark, d).select("a", "b", kernels.binned(F.col("q"), 50.0, 1000.0).alias("q"), kernels.binned(F.col("r"), 50.0, 1000.0).alias("r"))
    return rows.select("a", "b", r6(kernels.binned_cosine(F.col("q"), F.col("r")), "cosine"))


@query(f"""WITH c AS (SELECT unnest(['[M+H]+', '[M+Na]+', '[M-H]-', '[2M+H]+']) AS adduct, unnest([1, 1, -1, 1]) AS z, unnest([{mass.PROTON}, {mass.ELEMENTS['Na'] - mass.ELECTRON}, {-mass.PROTON}, {mass.ELEMENTS['H'] - mass.ELECTRON}]) AS shift, unnest([1, 1, 1, 2]) AS n)
    SELECT p_partkey, adduct, round((p_retailprice * abs(z) - shift) / n, 6) AS neutral FROM part, c""")
def adduct_masses(spark, d):
    """C1, C2."""
    names = F.explode(F.array(*[F.lit(x) for x in ("[M+H]+", "[M+Na]+", "[M-H]-", "[2M+H]+")]))
    rows = mass.with_adduct(t(spark, d, "part").select("p_partkey", "p_retailprice", names.alias("adduct")))
    return rows.select("p_partkey", "adduct", r6(mass.neutral_mass(F.col("p_retailprice"), F.col("charge"), F.col("shift"), F.col("molecules")), "neutral"))


@query(f"SELECT p_partkey, round((p_partkey % 9 + 1) * {mass.ELEMENTS['C']} + (p_size + 1) * {mass.ELEMENTS['H']} + {mass.ELEMENTS['Cl']}, 6)::DOUBLE AS mass FROM part")
def formula_masses(spark, d):
    """C4."""
    f = F.concat(F.lit("C"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("H"), (F.col("p_size") + 1).cast("string"), F.lit("Cl"))
    return t(spark, d, "part").select("p_partkey", r6(mass.formula_mass_of(f), "mass"))


@query("SELECT p_partkey, round(list_sum([p_size, p_partkey % 7, p_retailprice]::DOUBLE[]), 6) AS total FROM part")
def string_peaks(spark, d):
    """A3, C17: arrays in text, with commas and without."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), F.concat_ws(", ", "p_size", F.col("p_partkey") % 7, "p_retailprice"), F.lit("]"))).otherwise(F.concat(F.lit("["), F.concat_ws(" ", "p_size", F.col("p_partkey") % 7, "p_retailprice"), F.lit("]")))
    return t(spark, d, "part").select("p_partkey", r6(kernels.total(kernels.parsed(text)), "total"))
