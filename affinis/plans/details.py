"""Queries of fragments, analogs, reports, look-ups and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry, mass
from ..operators import features, joins, kernels, metrics, ranking, retrieval
from ..sources import tables
from ..store import scratch
from ..streaming import batches
from . import spectral_sql as sql
from .composite import library_spectra
from .queries import _CANDIDATES, _LIBRARY, _ONCE, _QUERIES, _RANKED, _RANKS, candidates_of, channels_of, library_of, queries_of, r6, ranked_of, ranks_of, spectra_of, spectrum_pairs, t
from .registry import query

_LOSSES = (10.0, 25.0, 50.0)
_PEAKS = """s AS (SELECT l_orderkey AS k, round((l_extendedprice / 100)::DECIMAL(18, 6), 2)::DOUBLE AS mz, l_quantity AS i, max(round((l_extendedprice / 100)::DECIMAL(18, 6), 2)::DOUBLE) OVER (PARTITION BY l_orderkey) + 1 AS precursor FROM lineitem),
    o AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, o_custkey FROM orders), n AS (SELECT k, count(*) AS n FROM s GROUP BY k)"""
_FLAGGED = f"""{_PEAKS}, f AS (SELECT o.a, o.b, o.o_custkey, n.n AS theoretical, s.mz, s.i, EXISTS (SELECT 1 FROM s u WHERE u.k = o.b AND abs(u.mz - s.mz) <= 5)::INT AS h, list_min(list_transform({list(_LOSSES)}, lambda x: abs(x - (s.precursor - s.mz)))) <= 5 AS l
    FROM o JOIN s ON s.k = o.a JOIN n ON n.k = o.b),
    g AS (SELECT a, b, o_custkey, theoretical, avg(h) AS peak_fraction, sum(i * h) / sum(i) AS intensity_fraction, sum(h)::DOUBLE AS matched_count, avg(h) FILTER (place <= 10) AS top_intensity_fraction, sum(i * mz * h) / sum(i * mz) AS mass_weighted_score, sum(i * l::INT) / sum(i) AS neutral_loss_score
    FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY i DESC, mz) AS place FROM f) GROUP BY a, b, o_custkey, theoretical)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    losses = F.array(*map(F.lit, _LOSSES))
    pairs = spectrum_pairs(spark, d)
    return pairs.select("a", "b", F.size("r").alias("theoretical"), kernels.fragment_scores(F.col("q"), F.transform("r", lambda p: p["mz"]), losses, F.col("qp"), 5.0).alias("f")).select("a", "b", "theoretical", "f.*")


@query(f"WITH {_FLAGGED} SELECT a, b, {', '.join(f'round({c}, 6) AS {c}' for c in kernels.FRAGMENT_SCORES)} FROM g")
def fragment_scores(spark, d):
    """The m/z of a customer's next order are the ions that an order's peaks are sought among."""
    return _scores(spark, d).select("a", "b", *[F.round(c, 6).alias(c) for c in kernels.FRAGMENT_SCORES])


_FOLDED = ", ".join(f"round({f}({n}), 6) AS fragment_{n}_{how}" for n in kernels.FRAGMENT_SCORES for f, how in (("max", "max"), ("avg", "mean")))


@query(f"WITH {_FLAGGED} SELECT o_custkey, 1::DOUBLE AS fragment_scored, max(theoretical)::DOUBLE AS fragment_theoretical_count, {_FOLDED} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a) AS r FROM g) WHERE r <= 8 GROUP BY o_custkey")
def fragment_features(spark, d):
    """14 features of eight spectra of a customer, the first by key."""
    owner = t(spark, d, "orders").select(F.col("o_orderkey").alias("a"), "o_custkey")
    rows = features.fragment_features(_scores(spark, d).join(owner, "a").withColumnRenamed("a", "spectrum"), ["o_custkey"])
    return rows.select("o_custkey", *[F.round(c, 6).alias(c) for c in features.FRAGMENT_FEATURES])


_SHIFT = f"CASE p_partkey % 3 WHEN 0 THEN [{-mass.ELEMENTS['H'] - mass.ELECTRON}, {-mass.PROTON}, 0, {mass.PROTON}] WHEN 1 THEN [{-mass.PROTON}, 0, {mass.ELEMENTS['H'] + mass.ELECTRON}] ELSE [{-mass.PROTON}, 0, {mass.PROTON}] END"


@query(f"SELECT p_partkey, count(DISTINCT v) AS n, round(sum(DISTINCT v), 5) AS total FROM (SELECT p_partkey, unnest(list_transform({_SHIFT}, lambda x: m + x)) AS v FROM (SELECT *, unnest([p_retailprice, p_size::DOUBLE, 0.5]) AS m FROM part)) WHERE v > 0 GROUP BY p_partkey")
def product_ions(spark, d):
    """A third of the parts each are positive, negative and unknown."""
    polarity = F.when(F.col("p_partkey") % 3 == 0, "positive").when(F.col("p_partkey") % 3 == 1, "negative").otherwise("unknown")
    ions = kernels.product_ions(F.array("p_retailprice", F.col("p_size").cast("double"), F.lit(0.5)), polarity, mass.ELEMENTS["H"], mass.PROTON, mass.ELECTRON)
    return t(spark, d, "part").select("p_partkey", ions.alias("i")).select("p_partkey", F.size("i").cast("long").alias("n"), F.round(kernels.total(F.col("i")), 5).alias("total"))


_BITS = "list_sum(list_transform(range(1, 65), lambda k: (c.e[k] > 0 {0} a.e[k] > 0)::INT))"
_ANALOGS = f"""c AS (SELECT label AS query, vec_id AS key, embedding AS e FROM embeddings), x AS (SELECT (label + 9) % 10 AS query, vec_id AS analog, greatest(0, (vec_id % 17 - 1) / 16.0)::DOUBLE AS s, embedding AS e FROM embeddings),
    z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, analog) AS r FROM x), p AS (SELECT c.query, c.key, a.analog, a.s, a.r, CASE WHEN {_BITS.format("OR")} > 0 THEN {_BITS.format("AND")} / {_BITS.format("OR")} ELSE 1 END AS t FROM c LEFT JOIN z a ON a.query = c.query AND a.r <= {{0}} AND a.query < 9)"""


def _analogs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings of a label are candidates, those of the next one analogs; the last label has none."""
    e = t(spark, d, "embeddings").select("vec_id", "label", kernels.packed(F.transform("embedding", lambda x: x > 0)).alias("w"))
    analogs = e.select(((F.col("label") + 9) % 10).alias("query"), F.col("vec_id").alias("analog"), ((F.col("vec_id") % 17 - 1) / 16).alias("similarity"), F.col("w").alias("analog_words"))
    return e.select(F.col("label").alias("query"), F.col("vec_id").alias("key"), F.col("w").alias("words")), analogs.filter("query < 9")


@query(f"""WITH {_ANALOGS.format(100)} SELECT query, key, round(coalesce(max(t * s ** 4), 0), 6) AS analog_score_power4, round(coalesce(max(t * s), 0), 6) AS analog_score_linear, round(coalesce(max(CASE WHEN r IS NOT NULL THEN t END), 0), 6) AS analog_tanimoto_max,
    round(coalesce(max(CASE WHEN r = 1 THEN t END), 0), 6) AS analog_tanimoto_top, round(coalesce(CASE WHEN sum(s ** 4) > 0 THEN sum(t * s ** 4) / sum(s ** 4) END, 0), 6) AS analog_tanimoto_weighted_mean, round(coalesce(max(CASE WHEN r = 1 THEN s END), 0), 6) AS analog_top_similarity FROM p GROUP BY query, key""")
def analog_evidence(spark, d):
    """The six features of each candidate."""
    return features.analog_evidence(*_analogs(spark, d)).select("query", "key", *[F.round(c, 6).alias(c) for c in features.ANALOG_FEATURES])


@query(f"""WITH {_ANALOGS.format(25)}, b AS (SELECT query, key, coalesce(max(CASE WHEN s * t > 0 THEN s * t END), 0) AS analog_score, arg_max(analog, (s * t, -r)) FILTER (s * t > 0) AS best_analog, exp(-(key % 30) / 20) AS m FROM p GROUP BY query, key)
    SELECT query, key, best_analog, round(analog_score, 6) AS analog_score, round(0.85 * analog_score + 0.15 * m, 6) AS final_score, row_number() OVER (PARTITION BY query ORDER BY round(0.85 * analog_score + 0.15 * m, 12) DESC, key)::INTEGER AS final_rank FROM b""")
def analog_propagation(spark, d):
    """25 analogs, a mass error from the key."""
    candidates, analogs = _analogs(spark, d)
    rows = features.propagated(candidates.withColumn("ppm", F.col("key") % 30), analogs.withColumn("similarity", F.greatest(F.lit(0.0), F.col("similarity"))))
    return rows.select("query", "key", "best_analog", r6(F.col("analog_score"), "analog_score"), r6(F.col("final_score"), "final_score"), "final_rank")


@query("""WITH q AS (SELECT vec_id AS query, label, list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE))) AS p FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS key, label, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings),
    r AS (SELECT query, key, unnest(p) AS p, unnest(b) AS b FROM q JOIN c USING (label)), s AS (SELECT query, key, sum(p * b) / (sum(p) + sum(b) - sum(p * b)) AS s FROM r GROUP BY ALL)
    SELECT query, key, similarity_rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, key)::INTEGER AS similarity_rank FROM s) WHERE similarity_rank <= 10""")
def expected_tanimoto_rank(spark, d):
    """Every twentieth embedding gives bit probabilities, those of its label are the candidates."""
    e = t(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label", F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("p"))
    c = e.select(F.col("vec_id").alias("key"), "label", kernels.unpacked(kernels.packed(F.transform("embedding", lambda x: x > 0)), 64).alias("bits"))
    return features.nearest_by_expected_tanimoto(q, c.withColumn("bits", F.transform("bits", lambda b: b.cast("int"))), 10, "label").select("query", "key", "similarity_rank", r6(F.col("similarity"), "similarity"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: (x > 0)::INT)[:50], '') AS bits FROM embeddings")
def unpack_bits(spark, d):
    """The first fifty bits of packed words."""
    return t(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(kernels.unpacked(kernels.packed(F.transform("embedding", lambda x: x > 0)), 50), lambda b: b.cast("int").cast("string")), "").alias("bits"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE))) AS p, list_transform(embedding, lambda x: (x + vec_id % 3 - 1 > 0)::INT) AS b FROM embeddings), r AS (SELECT vec_id, unnest(p) AS p, unnest(b) AS b FROM p),
    g AS (SELECT vec_id, -avg(b * ln(p) + (1 - b) * ln(1 - p)) AS bce, CASE WHEN sum((p >= 0.5 OR b = 1)::INT) > 0 THEN sum((p >= 0.5 AND b = 1)::INT) / sum((p >= 0.5 OR b = 1)::INT) ELSE 1 END AS t FROM r GROUP BY vec_id) SELECT round(avg(bce), 5) AS bce, round(avg(t), 6) AS tanimoto FROM g""")
def bit_metrics(spark, d):
    """G27, cross entropy and Tanimoto similarity of predictions."""
    rows = t(spark, d, "embeddings").select(F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("p"), F.transform("embedding", lambda x: (x + F.col("vec_id") % 3 - 1 > 0).cast("int")).alias("b"))
    return metrics.bit_metrics(rows, "p", "b").select(F.round("bce", 5).alias("bce"), r6(F.col("tanimoto"), "tanimoto"))


@query(f"""WITH s AS (SELECT q.qid, -q.mass AS mass FROM {_QUERIES} q WHERE q.qid % 2 = 0 UNION ALL SELECT q.qid, q.mass FROM {_QUERIES} q WHERE q.qid % 2 = 1), c AS (SELECT cid, CASE WHEN cid % 3 = 0 THEN -mass ELSE mass END AS mass FROM {_LIBRARY})
    SELECT qid, count(*) AS n FROM s JOIN c ON c.mass BETWEEN s.mass - abs(s.mass) * 20e-6 AND s.mass + abs(s.mass) * 20e-6 GROUP BY qid""")
def signed_window(spark, d):
    """A window around masses of either sign."""
    q = queries_of(spark, d).withColumn("mass", F.when(F.col("qid") % 2 == 0, -F.col("mass")).otherwise(F.col("mass")))
    c = library_of(spark, d).withColumn("mass", F.when(F.col("cid") % 3 == 0, -F.col("mass")).otherwise(F.col("mass")))
    return joins.library_window(q, c, 20.0).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.p_partkey AS qid, b.p_partkey AS cid FROM part a JOIN part b ON a.p_type = b.p_type AND b.p_retailprice BETWEEN a.p_retailprice - a.p_retailprice * 5000e-6 AND a.p_retailprice + a.p_retailprice * 5000e-6")
def mass_and_formula(spark, d):
    """J9."""
    rows = library_of(spark, d).select("cid", "mass", "formula")
    return joins.mass_and_formula(rows.withColumnRenamed("cid", "qid"), rows, 5000.0).select("qid", "cid")


@query(f"SELECT c.query, c.key, CASE WHEN x.key IS NULL THEN 'new' ELSE 'cached' END AS state, x.n FROM {_CANDIDATES} c LEFT JOIN (SELECT query, key, n FROM {_CANDIDATES} WHERE key % 4 = 0) x USING (query, key)")
def feature_cache(spark, d):
    """Scored pairs are reused, the rest is still to be scored."""
    c = candidates_of(spark, d, ("query", "key"))
    cached, new = joins.reused(c.select("query", "key"), c.filter("key % 4 = 0").select("query", "key", "n"), ["query", "key"])
    return cached.withColumn("state", F.lit("cached")).unionByName(new.withColumn("state", F.lit("new")), allowMissingColumns=True)


@query("SELECT p_partkey AS key, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def key_lookup(spark, d):
    """Rows of the keys that have one."""
    keys = t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("key")).distinct()
    return joins.looked_up(keys, t(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_brand"), "key")


@query("SELECT l_orderkey AS k, l_linenumber, o_custkey % 5 AS fold FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fold_lookup(spark, d):
    """Every line has its order's fold, else it is an error."""
    folds = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("fold"))
    return joins.with_fold(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber"), folds, "k")


@query("SELECT c_custkey AS query, c_custkey * 3 AS truth, c_custkey * 3 IN (SELECT p_partkey FROM part) AS present FROM customer")
def truth_in_database(spark, d):
    """J17."""
    manifest = t(spark, d, "customer").select(F.col("c_custkey").alias("query"), (F.col("c_custkey") * 3).alias("truth"))
    return joins.in_database(manifest, t(spark, d, "part").select(F.col("p_partkey").alias("key"))).select("query", "truth", "present")


@query("SELECT DISTINCT 'K' || lpad(p_partkey::VARCHAR, 13, '0') AS key FROM part WHERE p_size > 25")
def excluded_structures(spark, d):
    """P5: only names of 14 capitals or digits exclude a structure."""
    key = F.concat(F.when(F.col("p_size") > 25, "K").otherwise("k"), F.lpad(F.col("p_partkey").cast("string"), 13, "0"))
    return joins.excluded_structures(t(spark, d, "part").select(key.alias("key")))


@query("SELECT o_orderkey, o_custkey, NULL::VARCHAR AS smiles, NULL::BIGINT AS target FROM orders")
def stripped_labels(spark, d):
    """P7."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("smiles"), F.col("o_orderkey").alias("target"))
    return features.unlabelled(rows)


@query("SELECT p_partkey FROM part WHERE regexp_matches('[' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'c' END || ']', '\\[\\d+[A-Z]')")
def isotope_rows(spark, d):
    """P9."""
    smiles = F.concat(F.lit("["), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("c"), F.lit("]"))
    return t(spark, d, "part").filter(features.isotopic(smiles)).select("p_partkey")


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) / 300 AS m FROM orders GROUP BY o_custkey) SELECT CASE WHEN m < 250 THEN '<250' WHEN m < 350 THEN '250-350' WHEN m < 500 THEN '350-500' ELSE '>=500' END AS mass_bin,
    CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' ELSE '11+' END AS spectra, count(*) AS customers FROM c GROUP BY ALL""")
def binned_labels(spark, d):
    """P14."""
    rows = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 300).alias("m"))
    return rows.groupBy(features.mass_bin(F.col("m")).alias("mass_bin"), features.count_bin(F.col("n")).alias("spectra")).agg(F.count(F.lit(1)).alias("customers"))


@query("""SELECT l_returnflag, 'l_quantity' AS "column", min(l_quantity) AS min, median(l_quantity) AS median, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS max, count(l_quantity) AS n FROM lineitem GROUP BY l_returnflag UNION ALL
    SELECT l_returnflag, 'l_linenumber', min(l_linenumber)::DOUBLE, median(l_linenumber)::DOUBLE, round(avg(l_linenumber), 6), max(l_linenumber)::DOUBLE, count(l_linenumber) FROM lineitem GROUP BY l_returnflag""")
def described(spark, d):
    """G9, R8."""
    return metrics.described(t(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], ["l_returnflag"]).withColumn("mean", F.round("mean", 6))


@query("SELECT element, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT unnest(list_transform(embedding, lambda x: round(x)::INT)) AS element FROM embeddings) GROUP BY element")
def list_distribution(spark, d):
    """G13, R8."""
    rows = t(spark, d, "embeddings").select(F.transform("embedding", lambda x: F.rint(x.cast("double")).cast("int")).alias("v"))
    return metrics.element_frequencies(rows, "v").withColumn("share", F.round("share", 6))


@query("SELECT count(*) AS n_distinct, sum(n - 1)::BIGINT AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_returnflag)")
def repeated_structs(spark, d):
    """Rows that are alike, by their values, where a hash could collide."""
    return metrics.repeated(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"])


@query("SELECT l_suppkey, count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS positives FROM lineitem GROUP BY l_suppkey")
def group_counts(spark, d):
    """G28."""
    return metrics.group_counts(t(spark, d, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) >= 2")
def having_two(spark, d):
    """G29."""
    return metrics.frequencies(t(spark, d, "lineitem"), "l_partkey", 2)


@query(f"""SELECT n_name AS nation, k::INTEGER AS cutoff, count(*) AS queries, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS recall FROM (SELECT DISTINCT c.c_custkey AS query, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey OR n.n_nationkey = c.c_custkey % 25) m
    JOIN {_RANKS} r USING (query), (SELECT unnest([5, 50]) AS k) GROUP BY ALL""")
def membership_recall(spark, d):
    """A customer counts in its own nation and in another."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    both = c.select(F.col("c_custkey").alias("query"), F.explode(F.array("c_nationkey", (F.col("c_custkey") % 25).cast("int"))).alias("n_nationkey"))
    members = both.join(n, "n_nationkey").select("query", F.col("n_name").alias("nation"))
    return metrics.membership_recall(ranks_of(spark, d).select("query", "rank"), members, [5, 50], "nation").select("nation", "cutoff", "queries", r6(F.col("recall"), "recall"))


_TRUE_KEY = f"(SELECT query, min(key) AS truth FROM {_CANDIDATES} WHERE key % 5 = 0 GROUP BY query)"


@query(f"""WITH t AS (SELECT c_custkey AS query, coalesce(truth, -1) AS truth FROM customer LEFT JOIN {_TRUE_KEY} ON query = c_custkey), g AS (SELECT query, key AS gate_key, s2 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s2 DESC, key) AS r FROM {_CANDIDATES}) WHERE r = 1 AND n > 1),
    h AS (SELECT unnest([0.0, 50.0, 90.0, 1000.0]) AS h), b AS (SELECT h, query, key, rank FROM {_RANKED}, h UNION ALL SELECT h, query, gate_key, 0 FROM g, h WHERE confidence >= h),
    o AS (SELECT h, query, key, row_number() OVER (PARTITION BY h, query ORDER BY min(rank)) AS rank FROM b GROUP BY h, query, key), m AS (SELECT h.h, t.query, t.truth, (SELECT min(rank) FROM o WHERE o.h = h.h AND o.query = t.query AND o.key = t.truth) AS rank FROM t, h)
    SELECT h::INTEGER AS threshold, count(*) FILTER (g.confidence >= h) AS gated, round(sum((g.gate_key = m.truth)::INT) FILTER (g.confidence >= h) / nullif(count(*) FILTER (g.confidence >= h), 0), 6) AS precision, round(avg(CASE WHEN rank <= 25 THEN 1 / rank ELSE 0 END), 6) AS mrr FROM m LEFT JOIN g USING (query) GROUP BY h""")
def gate_sweep(spark, d):
    """The best by quantity goes first from each threshold on, if it has two lines."""
    c = candidates_of(spark, d)
    known = c.filter("key % 5 = 0").groupBy("query").agg(F.min("key").alias("truth"))
    manifest = t(spark, d, "customer").select(F.col("c_custkey").alias("query")).join(known, "query", "left").withColumn("truth", F.coalesce("truth", F.lit(-1)))
    top = ranking.first_of(c, ["query"], F.col("s2").desc(), F.col("key")).withColumn("confidence", F.col("s2"))
    rows = metrics.gate_sweep(manifest, ranked_of(spark, d), top, [0.0, 50.0, 90.0, 1000.0], F.col("n") > 1)
    return rows.select(F.col("threshold").cast("int").alias("threshold"), "gated", r6(F.col("precision"), "precision"), r6(F.col("mrr"), "mrr"))


@query(f"""WITH o AS (SELECT query, key, sum(1 / (60 + nr)) AS score, min((channel, nr)) AS seen FROM {_ONCE.replace("key % 50 AS key", "key")} WHERE channel <> 'c' GROUP BY query, key), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, seen, key)::INTEGER AS fused_rank FROM o)
    SELECT c_custkey AS query, key, round(score, 6) AS score, fused_rank FROM customer LEFT JOIN r ON r.query = c_custkey""")
def ensemble(spark, d):
    """a frame with a column for each channel is unpivoted and fused; customers without a candidate stay."""
    wide = channels_of(spark, d).filter("channel <> 'c'").groupBy("query", "key").pivot("channel", ["a", "b"]).agg(F.min("rank"))
    fused = ranking.rank_fusion(ranking.unpivoted(wide, {"a": "a", "b": "b"})).withColumn("score", F.round("score", 6))
    return ranking.completed(fused, t(spark, d, "customer").select(F.col("c_custkey").alias("query")))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderkey) AS r FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey) WHERE r <= 3")
def richest_three(spark, d):
    """The three spectra with most peaks of each customer."""
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_n(t(spark, d, "orders").join(n, "o_orderkey"), ["o_custkey"], 3, F.col("n").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber)::INTEGER AS rank FROM lineitem")
def first_ranks(spark, d):
    """Ranks whose ties go by the line number, a column that stands for the order of the input."""
    return ranking.ranked(t(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity").desc(), F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "rank")


_PLACED = "(SELECT *, row_number() OVER () AS place FROM lineitem)"


def ordered_lines(spark, d):
    """Line items with their place in the input."""
    return tables.in_input_order(spark, f"{d}/lineitem.parquet")


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, place)::INTEGER AS rank FROM {_PLACED}")
def input_order_ranks(spark, d):
    """Ranks in a supplier, the first in the input of equals first."""
    return ranking.ranked(ordered_lines(spark, d), ["l_suppkey"], F.col("l_quantity").desc(), F.col("input_order")).select("l_orderkey", "l_linenumber", "rank")


@query(f"SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, place) AS r FROM {_PLACED}) WHERE r = 1")
def input_order_richest(spark, d):
    """Of each supplier the row with most, the first in the input of equals."""
    return ranking.first_of(ordered_lines(spark, d), ["l_suppkey"], F.col("l_quantity").desc(), F.col("input_order")).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(f"SELECT l_partkey, round(max(l_quantity), 6) AS most, round(avg(l_quantity), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY place) AS r FROM {_PLACED}) WHERE r <= 8 GROUP BY l_partkey")
def input_order_fragments(spark, d):
    """Maximum and mean over the first eight rows of each part in the input."""
    rows = ordered_lines(spark, d).select("l_partkey", "input_order", F.lit(3).alias("theoretical"), *[F.col("l_quantity").cast("double").alias(c) for c in features.FRAGMENT_SCORES])
    most, mean = features.FRAGMENT_FEATURES[2:4]
    return features.fragment_features(rows, ["l_partkey"], order="input_order").select("l_partkey", F.round(most, 6).alias("most"), F.round(mean, 6).alias("mean"))


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, place)::INTEGER AS analog_rank FROM {_PLACED}")
def input_order_analogs(spark, d):
    """Analog ranks whose ties keep the order of the input."""
    rows = ordered_lines(spark, d).select(F.col("l_suppkey").alias("molecule_id"), "l_orderkey", "l_linenumber", "input_order", *[F.col("l_quantity").cast("double").alias(c) for c in features.ANALOG_FEATURES])
    return features.analog_features(rows, ties="input_order").select("l_orderkey", "l_linenumber", F.col("analog_rank").cast("int").alias("analog_rank"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || '; ;' || p_brand || ' ;', ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def candidate_list(spark, d):
    """C14."""
    text = F.concat("p_type", F.lit("; ;"), "p_brand", F.lit(" ;"))
    return t(spark, d, "part").select("p_partkey", F.array_join(ranking.listed(text), "|").alias("parts"))


@query("SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 48 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def key_union(spark, d):
    """Keys that either side has."""
    a = t(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("key"))
    return a.unionByName(t(spark, d, "part").filter("p_size < 5").select(F.col("p_partkey").alias("key"))).distinct()


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 > 0)")
def shared_structures(spark, d):
    """Structures that training and validation share."""
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "key")
    return o.filter("o_orderkey % 5 = 0").select("key").intersect(o.filter("o_orderkey % 5 > 0").select("key"))


@query("SELECT bit::INTEGER AS bit, round(avg((l_quantity::BIGINT >> bit::INT) & 1), 6) AS share FROM lineitem, range(8) b(bit) GROUP BY ALL HAVING min((l_quantity::BIGINT >> bit::INT) & 1) < max((l_quantity::BIGINT >> bit::INT) & 1)")
def variable_bits(spark, d):
    """Bits that vary, at most 128."""
    rows = t(spark, d, "lineitem").select(F.array(*[F.shiftright(F.col("l_quantity").cast("long"), i).bitwiseAND(1) for i in range(8)]).alias("b"))
    return metrics.variable_bits(rows, "b").select("bit", r6(F.col("share"), "share"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_counts(spark, d):
    """An extension: events are read as a stream, batch by batch, each batch's counts written once; a second call finds nothing new."""
    base = scratch(spark)
    schema = t(spark, d, "events").schema
    for _ in range(2):
        batches.in_batches(spark, f"{d}/events.parque[t]", schema, lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query(f"SELECT key, mode, cid, len(p) AS peaks FROM (SELECT *, row_number() OVER (PARTITION BY key, mode ORDER BY len(p) DESC, cid) AS r FROM {sql.LIBRARY} WHERE cid % 7 > 0) WHERE r = 1")
def raw_representatives(spark, d):
    """The richest spectrum of each structure and polarity, of those with a finite mass, which a seventh has not."""
    rows = library_spectra(spark, d).withColumn("mass", F.when(F.col("cid") % 7 > 0, F.col("mass")).otherwise(float("nan")))
    return retrieval.representatives(rows, raw=True).select("key", "mode", "cid", F.size("peaks").cast("long").alias("peaks"))


@query(f"""WITH s AS (SELECT k, unnest(p) AS z, precursor FROM {sql.SPECTRA}), b AS (SELECT k, any_value(precursor) AS precursor, floor(z.mz / 50)::INT AS b, max(z.i) AS i FROM s WHERE floor(z.mz / 50) < 20 GROUP BY ALL), n AS (SELECT k, sum(i) / max(i) AS total, count(*) AS bins FROM b GROUP BY k)
    SELECT o.k AS l_orderkey, 22 AS size, round(coalesce(total, 0) + precursor, 8) AS total, coalesce(bins, 0) + 1 AS filled FROM {sql.SPECTRA} o LEFT JOIN n ON n.k = o.k""")
def feature_vectors(spark, d):
    """Twenty bins over their maximum, the precursor, and a number that is none."""
    v = kernels.feature_vector(F.col("peaks"), [F.col("precursor"), F.lit(float("nan"))], 50.0, 1000.0)
    rows = spectra_of(spark, d).select("l_orderkey", v.alias("v"))
    return rows.select("l_orderkey", F.size("v").alias("size"), F.round(kernels.total(F.col("v")), 8).alias("total"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("filled"))


@query("""WITH p AS (SELECT l_orderkey, l_quantity AS l, sqrt(l_quantity) AS i, max(l_quantity) OVER w AS q, max(sqrt(l_quantity)) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
    SELECT l_orderkey, substr('STRUCTURE' || lpad(l_orderkey::VARCHAR, 9, '0'), 1, 14) AS key, count(*)::INTEGER AS num_peaks, round(sum(i / m), 6) AS total FROM p WHERE l >= 0.2 * q GROUP BY l_orderkey""")
def preprocessed_spectra(spark, d):
    """Cleaned spectra with their number of peaks, key and mass."""
    rows = spectra_of(spark, d).withColumnRenamed("precursor", "precursor_mz")
    key = F.concat(F.lit("STRUCTURE"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"))
    out = tables.preprocessed(rows, key, F.col("precursor_mz") - 1, relative_floor=0.2, top_n=50)
    return out.select("l_orderkey", "key", "num_peaks", r6(kernels.total(F.col("peaks"), lambda x: x["intensity"]), "total"))


@query("SELECT o_orderkey, CASE WHEN p_partkey % 5 > 0 THEN 'C' || p_partkey END AS canonical_smiles, CASE WHEN p_partkey % 5 > 0 THEN 'K' || lpad(p_partkey::VARCHAR, 13, '0') END AS inchikey14, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS exact_mass, CASE WHEN p_partkey % 5 = 1 THEN 'ACYCLIC:K' || lpad(p_partkey::VARCHAR, 13, '0') WHEN p_partkey % 5 > 1 THEN p_brand END AS scaffold FROM orders LEFT JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) + 1")
def described_structures(spark, d):
    """Structures looked up in a made-up table of known ones, each once (no structure is read); a fifth is not valid, a fifth has no scaffold."""
    part = t(spark, d, "part")
    smiles = F.concat(F.lit("S"), F.col("p_partkey").cast("string"))
    key = F.concat(F.lit("K"), F.lpad(F.col("p_partkey").cast("string"), 13, "0"))
    known = part.filter("p_partkey % 5 > 0").select(smiles.alias("smiles"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("canonical_smiles"), key.alias("inchikey14"), F.lit("C").alias("formula"), F.col("p_retailprice").alias("exact_mass"), F.when(F.col("p_partkey") % 5 == 1, "").otherwise(F.col("p_brand")).alias("scaffold"))
    rows = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("S"), (F.col("o_orderkey") % part.count() + 1).cast("string")).alias("smiles"))
    return chemistry.described(rows, chemistry.Precomputed(known)).select("o_orderkey", "canonical_smiles", "inchikey14", "exact_mass", "scaffold")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ABCDEFGHIJKLMN' END AS key FROM part")
def comparison_keys(spark, d):
    """What is a key passes."""
    text = F.when(F.col("p_partkey") % 2 == 0, "ABCDEFGHIJKLMN").otherwise(F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", chemistry.comparison_key(text).alias("key"))


@query("SELECT p_partkey % 97 AS inchikey, min_by(p_name, (p_size % 2, p_partkey)) AS name FROM part WHERE p_partkey % 3 > 0 GROUP BY p_partkey % 97")
def merged_candidates(spark, d):
    """Two sources, the first of which wins; rows without a mass are no candidates."""
    part = t(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("candidate_id"), F.col("p_name").alias("canonical_smiles"), F.lpad((F.col("p_partkey") % 97).cast("string"), 14, "0").alias("inchikey14"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).alias("exact_mass"), "p_size")
    rows = tables.merged_candidates([part.filter(f"p_size % 2 = {i}").drop("p_size") for i in (0, 1)])
    return rows.select(F.col("inchikey14").cast("long").alias("inchikey"), F.col("canonical_smiles").alias("name"))
