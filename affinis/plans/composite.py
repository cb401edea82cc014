"""Queries of the composite operators: searches, folds, features, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence, features, listwise, metrics, network, ranking, retrieval
from ..store import settled
from . import spectral_sql as sql
from .queries import _CANDIDATES, _CHANNELS, _RANKED, _TRUTH, candidates_of, channels_of, r6, ranked_of, spectra_of, t, truth_of
from .registry import query


def library_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Orders as library spectra: total price is the mass, the customer the structure, the status the polarity."""
    s = spectra_of(spark, d).select(F.col("l_orderkey").alias("cid"), "peaks")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("cid"), F.col("o_custkey").alias("key"), (F.col("o_totalprice") / 100).alias("mass"), F.col("o_orderstatus").alias("mode"))
    return o.join(s, "cid")


def as_queries(library: DataFrame) -> DataFrame:
    return library.withColumnRenamed("cid", "qid").withColumnRenamed("key", "query")


def query_spectra(spark: SparkSession, d: str) -> DataFrame:
    return as_queries(library_spectra(spark, d))


_HITS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS place FROM {sql.hits('c.mass BETWEEN q.mass - q.mass * 2000e-6 AND q.mass + q.mass * 2000e-6')}))"


@query(f"SELECT qid, cid, key, round(direct, 6) AS direct, matched, round(score, 6) AS score FROM {_HITS} WHERE place <= 10")
def library_search(spark, d):
    """Every order against all others in a 2000 ppm window, its own spectrum left out; orders alone in their window meet their neighbours."""
    spectra = settled(library_spectra(spark, d))  # read by either side, several times
    hits = retrieval.search(as_queries(spectra), spectra, ppm=2000.0, tolerance=5.0, top_n=10)
    return hits.select("qid", "cid", "key", r6(F.col("direct"), "direct"), "matched", r6(F.col("score"), "score"))


_SUPPORT = f"""(SELECT query, key, max(direct) AS max_direct, avg(direct) FILTER (r <= 3) AS top_direct, max(modified) AS max_modified, max(loss) AS max_loss, count(DISTINCT qid) AS spectra, count(DISTINCT cid) AS libraries, max(matched)::INTEGER AS matched,
    max(explained) AS explained, min(ppm) AS least_ppm, arg_max(cid, (round(score, 9), -cid)) AS best FROM (SELECT h.*, abs(1e6 * (a.o_totalprice / 100 - b.o_totalprice / 100) / (b.o_totalprice / 100)) AS ppm, row_number() OVER (PARTITION BY query, key ORDER BY direct DESC, cid, qid) AS r
    FROM {_HITS} h JOIN orders a ON a.o_orderkey = h.qid JOIN orders b ON b.o_orderkey = h.cid WHERE place <= 10) GROUP BY query, key)"""


def supported(spark: SparkSession, d: str) -> DataFrame:
    """The support of customers by the ten best hits of their orders."""
    spectra = settled(library_spectra(spark, d))
    hits = retrieval.search(as_queries(spectra), spectra, ppm=2000.0, tolerance=5.0, top_n=10)
    return evidence.hit_support(hits, ["query", "key"])


@query(f"SELECT query, key, {', '.join(f'round({c}, 6) AS {c}' for c in ('max_direct', 'top_direct', 'max_modified', 'max_loss', 'explained', 'least_ppm'))}, spectra, libraries, matched, best FROM {_SUPPORT}")
def hit_support(spark, d):
    """G1: what all hits of a customer's orders say of another one."""
    digits = ("max_direct", "top_direct", "max_modified", "max_loss", "explained", "least_ppm")
    return supported(spark, d).select("query", "key", *[r6(F.col(c), c) for c in digits], "spectra", "libraries", "matched", "best")


@query(f"""WITH s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(max_direct, 9) DESC, key) AS r FROM {_SUPPORT}), g AS (SELECT query, key FROM s WHERE r = 1 AND max_direct >= 0.5 AND explained >= 0.25 AND matched >= 1),
    k AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY least_ppm, key) AS rank FROM s), b AS (SELECT query, key, rank, 'ranker' AS source FROM k UNION ALL SELECT query, key, 0, 'gate' FROM g), o AS (SELECT query, key, min((rank, source)) AS b FROM b GROUP BY ALL)
    SELECT query, key, CAST(row_number() OVER (PARTITION BY query ORDER BY b[1], key) AS INTEGER) AS rank, b[2] AS source FROM o""")
def threefold_gate(spark, d):
    """The best spectral hit goes before a ranking by mass where cosine, explained intensity and matched peaks all suffice."""
    found = settled(supported(spark, d))  # ranked twice
    spectral = ranking.ranked(found, ["query"], F.round("max_direct", 9).desc(), F.col("key"))
    by_mass = ranking.ranked(found.select("query", "key", "least_ppm"), ["query"], F.col("least_ppm"), F.col("key"))
    return ranking.gated(by_mass, spectral, ranking.confident(least=(0.5, 0.25, 1))).select("query", "key", "rank", "source")


_ANALOG_HITS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS place FROM {sql.hits('c.mass BETWEEN q.mass - 200 AND q.mass + 200', 5000, 'cid % 100 = 1')}))"


@query(f"SELECT qid, cid, key, round(direct, 6) AS direct, matched, round(score, 6) AS score FROM {_ANALOG_HITS} WHERE place <= 10")
def analog_search(spark, d):
    """Every hundredth order against all others in +- 200, of which 5000 at equal steps of mass are compared, as in the reference."""
    q = query_spectra(spark, d).filter("qid % 100 = 1")
    hits = retrieval.search(q, library_spectra(spark, d), da=200.0, tolerance=5.0, most=5000, top_n=10)
    return hits.select("qid", "cid", "key", r6(F.col("direct"), "direct"), "matched", r6(F.col("score"), "score"))


@query(f"""WITH e AS (SELECT query, key, avg(s) AS e FROM (SELECT query, key, least(1.0, greatest(0.0, score)) AS s, row_number() OVER (PARTITION BY query, key ORDER BY least(1.0, greatest(0.0, score)) DESC) AS r FROM {_HITS} WHERE place <= 100) WHERE r <= 3 GROUP BY query, key),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(e, 9) DESC, key) AS rank FROM e), t AS (SELECT m.query, k.rank FROM (SELECT DISTINCT o_custkey AS query FROM orders JOIN lineitem ON l_orderkey = o_orderkey) m LEFT JOIN k ON k.query = m.query AND k.key = m.query AND k.rank <= 25)
    SELECT count(*) AS queries, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, {", ".join(f"round(avg(coalesce((rank <= {c})::INT, 0)), 6) AS hits_{c}" for c in metrics.CUTOFFS)}, median(rank)::DOUBLE AS median_rank, round(avg((rank IS NULL)::INT), 6) AS missed FROM t""")
def predict_evaluate(spark, d):
    """R2, F16: fit, predict, evaluate; the truth of a customer's spectra is the customer."""
    spectra = settled(library_spectra(spark, d))
    q = as_queries(spectra)
    found = retrieval.predict(q, spectra, ppm=2000.0, tolerance=5.0)
    m = retrieval.evaluate(q.select("query", F.col("query").alias("truth")).distinct(), found)
    return m.select(*[F.col(c) if c in ("queries", "median_rank") else F.round(c, 6).alias(c) for c in m.columns])


_REPRESENTATIVES = sql.weighted_rows(f"(SELECT key, arg_max(mass, (len(p), -cid)) AS mass, arg_max(mode, (len(p), -cid)) AS mode, arg_max(p, (len(p), -cid)) AS p, arg_max(cid, (len(p), -cid)) AS cid FROM {sql.LIBRARY} GROUP BY key)", "p", "key, mass, mode, cid", "r")
_SEARCHED = sql.weighted_rows(f"(SELECT c.key AS query, m.mass, c.mode, c.p FROM {sql.LIBRARY} c JOIN (SELECT key, median(mass) AS mass FROM {sql.LIBRARY} GROUP BY key) m ON m.key = c.key)", "p", "query, mass, mode", "q")


@query(f"""WITH x AS MATERIALIZED (SELECT * FROM {_REPRESENTATIVES}), y AS MATERIALIZED (SELECT * FROM {_SEARCHED}), s AS (SELECT query, key, cid, d, greatest({sql.similarity('q', 'r', 5, '0')}, CASE WHEN abs(d) > 0.001 THEN {sql.similarity('q', 'r', 5, 'd')} ELSE 0 END) AS s
    FROM (SELECT y.query, y.q, x.key, x.cid, x.r, y.mass - x.mass AS d FROM y JOIN x ON x.mass BETWEEN y.mass - 200 AND y.mass + 200 AND x.mode = y.mode AND x.key <> y.query)), b AS (SELECT query, key, max(s) AS s, any_value(cid) AS cid, any_value(d) AS d FROM s GROUP BY query, key HAVING round(max(s), 9) > 0)
    SELECT query, key, round(s, 6) AS similarity, cid, round(d, 6) AS mass_delta FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, key) AS place FROM b) WHERE place <= 25""")
def entropy_search(spark, d):
    """Customers against richest representatives, themselves excluded."""
    # Read three times, so made once.
    q = settled(query_spectra(spark, d))
    index = settled(retrieval.representatives(q.withColumnRenamed("qid", "cid").withColumnRenamed("query", "key")))
    own = q.select("query", F.col("query").alias("key")).distinct()
    return retrieval.entropy_search(q, index, tolerance=5.0, excluded=own).select("query", "key", r6(F.col("similarity"), "similarity"), "cid", r6(F.col("mass_delta"), "mass_delta"))


@query("""WITH RECURSIVE s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), g AS (SELECT n, row_number() OVER (ORDER BY n DESC, o_custkey) AS i FROM s),
    r(i, loads) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL SELECT g.i, list_transform(r.loads, lambda x, k: x + CASE WHEN k = list_position(r.loads, list_min(r.loads)) THEN g.n ELSE 0 END) FROM r JOIN g ON g.i = r.i + 1)
    SELECT (k - 1)::SMALLINT AS fold, loads[k]::BIGINT AS n, true AS whole FROM (SELECT arg_max(loads, i) AS loads FROM r), range(1, 6) t(k)""")
def grouped_folds(spark, d):
    """rows of each fold by the greedy rule, and that no group is in two."""
    rows = retrieval.folds_by_size(t(spark, d, "orders"), "o_custkey", 5)
    leaks = metrics.in_several_folds(rows, "o_custkey", "fold").isEmpty()
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).withColumn("whole", F.lit(leaks))


_FRAME = f"""(SELECT *, query AS molecule_id, 'K' || key AS inchikey14, count(*) OVER q AS candidate_count, row_number() OVER (PARTITION BY query ORDER BY s2 DESC, key) AS mass_rank, s3 * 1000 - 20 AS ppm, sum(n) OVER q AS spectra,
    avg(s3) OVER q AS energy FROM {_RANKED} WINDOW q AS (PARTITION BY query))"""


def frame_of(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of customers as a feature frame: prices are scores, quantities order by mass, taxes are mass errors."""
    w = Window.partitionBy("query")
    rows = ranking.ranked(ranked_of(spark, d), ["query"], F.col("s2").desc(), F.col("key"), name="mass_rank")
    ppm, even = F.col("s3") * 1000 - 20, F.col("key") % 2 == 0
    return rows.select(
        "query", "key", "s1", "s2", "s3", "n", F.col("query").alias("molecule_id"), F.concat(F.lit("K"), F.col("key").cast("string")).alias("inchikey14"), F.lit("C").alias("smiles"), F.when(even, "PubChemLite").otherwise("ChEMBL").alias("source"),
        F.when(even, "CH4").alias("formula"), ((F.col("rank") == 1) & (F.col("n") > 1)).cast("int").alias("target"), "rank", "mass_rank", ppm.alias("mass_error_ppm"), F.abs(ppm).alias("absolute_mass_error_ppm"), F.exp(-F.abs(ppm) / 20).alias("mass_score_20ppm"),
        *[(F.abs(ppm) <= p).cast("int").alias(f"within_{p}ppm") for p in (20, 50, 1000)], F.col("s1").alias("predicted_fingerprint_score"), F.col("s2").alias("candidate_exact_mass"), F.col("s3").alias("neutral_mass"), F.count(F.lit(1)).over(w).alias("candidate_count"),
        F.sum("n").over(w).alias("query_spectrum_count"), F.lit(1).alias("query_adduct_count"), F.lit(0.5).alias("query_positive_fraction"), F.avg("s3").over(w).alias("query_mean_collision_energy"),
    )


_Z = "CASE WHEN coalesce(stddev_samp({0}) OVER q, 0) > 0 THEN ({0} - avg({0}) OVER q) / stddev_samp({0}) OVER q ELSE 0 END"
_FEATURES = {
    "mass_rank": "mass_rank", "reciprocal_mass_rank": "1 / mass_rank", "mass_rank_percentile": "mass_rank / candidate_count", "mass_error_ppm": "ppm", "absolute_mass_error_ppm": "abs(ppm)", "log_absolute_mass_error_ppm": "ln(1 + abs(ppm))",
    "mass_score_20ppm": "exp(-abs(ppm) / 20)", **{f"within_{p}ppm": f"(abs(ppm) <= {p})::INT" for p in (20, 50, 1000)}, "predicted_fingerprint_score": "s1", "fingerprint_rank": "rank", "reciprocal_fingerprint_rank": "1 / rank",
    "fingerprint_rank_percentile": "rank / candidate_count", "fingerprint_score_z": _Z.format("s1"), "wide_mass_rank": "mass_rank", "wide_fingerprint_rank": "rank", "wide_mass_rank_percentile": "mass_rank / candidate_count",
    "wide_fingerprint_rank_percentile": "rank / candidate_count", "wide_candidate_count": "candidate_count", "candidate_exact_mass": "s2", "neutral_mass": "s3", "candidate_count": "candidate_count", "query_spectrum_count": "spectra",
    "query_adduct_count": "1", "query_positive_fraction": "0.5", "query_mean_collision_energy": "energy", "source_coconut": "0", "source_pubchemlite": "(key % 2 = 0)::INT", "source_chembl": "(key % 2 = 1)::INT", "has_formula": "(key % 2 = 0)::INT",
    "candidate_heteroatom_count": "CASE WHEN key % 5 > 0 THEN key % 7 ELSE 0 END", "candidate_ring_count": "CASE WHEN key % 5 > 0 THEN key % 3 ELSE 0 END", "candidate_aromatic_fraction": "CASE WHEN key % 5 > 0 THEN key % 11 / 11 ELSE 0 END",
    "candidate_logp": "0", **dict.fromkeys(features.FRAGMENT_FEATURES, "0"),
}


@query(f"SELECT molecule_id, inchikey14, {', '.join(f'round(({e})::DOUBLE, 6) AS {n}' for n, e in _FEATURES.items())} FROM {_FRAME} WINDOW q AS (PARTITION BY query)")
def ranking_features(spark, d):
    """The 49 features of a checked frame; descriptors of four fifths of the structures, one of them not a number."""
    rows = features.checked(frame_of(spark, d))
    known = t(spark, d, "part").filter("p_partkey % 5 > 0").selectExpr("concat('K', p_partkey) AS inchikey14", "double(p_partkey % 7) AS candidate_heteroatom_count", "double(p_partkey % 3) AS candidate_ring_count", "p_partkey % 11 / 11D AS candidate_aromatic_fraction", "double('nan') AS candidate_logp")
    out = features.ranking_features(rows, known)
    return features.selected(out, ["molecule_id", "inchikey14", *features.RANKING_FEATURES]).select("molecule_id", "inchikey14", *[F.round(c, 6).alias(c) for c in features.RANKING_FEATURES])


@query(f"""SELECT molecule_id, inchikey14, round(s2::DOUBLE, 6) AS analog_score_power4, round(s3::DOUBLE, 6) AS analog_score_linear, 0.5::DOUBLE AS analog_tanimoto_max, 0::DOUBLE AS analog_tanimoto_top, 0::DOUBLE AS analog_tanimoto_weighted_mean, 1::DOUBLE AS analog_top_similarity,
    ar::DOUBLE AS analog_rank, round(1 / ar, 6) AS reciprocal_analog_rank, round((ar - 1) / greatest(candidate_count - 1, 1), 6) AS analog_rank_percentile, round((max(s2) OVER q)::DOUBLE, 6) AS analog_score_max, round((s2 - max(s2) OVER q)::DOUBLE, 6) AS analog_score_delta_max,
    round(({_Z.format('s2')})::DOUBLE, 6) AS analog_score_z FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s2 DESC, rank) AS ar FROM {_FRAME}) WINDOW q AS (PARTITION BY query)""")
def analog_features(spark, d):
    """The 12 features; what is not a number becomes 0."""
    rows = frame_of(spark, d).selectExpr("molecule_id", "inchikey14", "rank", "s2 AS analog_score_power4", "s3 AS analog_score_linear", "0.5D AS analog_tanimoto_max", "double('nan') AS analog_tanimoto_top", "double(null) AS analog_tanimoto_weighted_mean", "1D AS analog_top_similarity")
    return features.analog_features(rows).select("molecule_id", "inchikey14", *[F.round(c, 6).alias(c) for c in features.ANALOG_RANKING_FEATURES])


@query(f"SELECT fault, n FROM (SELECT unnest(['repeated', 'target', 'positives']) AS fault, unnest([(SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1)), (SELECT count(*) FROM lineitem WHERE l_linenumber = 3), (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey HAVING sum(CASE l_linenumber WHEN 1 THEN 1 WHEN 3 THEN 7 ELSE 0 END) > 1))]) AS n) WHERE n > 0")
def frame_faults(spark, d):
    """What is wrong with a frame that repeats pairs, has odd targets and several positives."""
    target = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 3, 7).otherwise(0)
    return features.faults(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("molecule_id"), F.col("l_partkey").alias("inchikey14"), target.alias("target")))


@query(f"SELECT molecule_id, inchikey14 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY least(mass_rank, rank), mass_rank, inchikey14) AS r FROM {_FRAME}) WHERE r <= 10")
def bounded_selection(spark, d):
    """F12."""
    return features.bounded(frame_of(spark, d), 10, "molecule_id", "inchikey14").select("molecule_id", "inchikey14")


@query(f"SELECT c.query, c.key, coalesce(x.n, 0)::BIGINT AS raw_n FROM {_CANDIDATES} c LEFT JOIN (SELECT query, key, n FROM {_CANDIDATES} WHERE key % 3 = 0) x USING (query, key)")
def feature_merge(spark, d):
    """J10, J11."""
    c = candidates_of(spark, d)
    return features.merged(c.select("query", "key"), c.filter("key % 3 = 0").select("query", "key", "n"), "raw_", ["query", "key"])


_TRUE = f"(SELECT query, min(key) AS truth FROM {_CANDIDATES} WHERE n > 1 OR key % 5 = 0 GROUP BY query)"


@query(f"""WITH r AS (SELECT c.query, w.w, c.key, m.truth, row_number() OVER (PARTITION BY c.query, w.w ORDER BY w.w * s2 + (1 - w.w) * s3 DESC, c.key) AS r FROM {_CANDIDATES} c JOIN {_TRUE} m USING (query), (SELECT i / 20 AS w FROM range(21) x(i)) w)
    SELECT round(w, 6) AS weight, round(avg(CASE WHEN r <= 25 THEN 1.0 / r ELSE 0 END), 6) AS mrr FROM r WHERE key = truth GROUP BY w""")
def blend_grid(spark, d):
    """21 weights."""
    c = candidates_of(spark, d)
    manifest = c.filter("n > 1 OR key % 5 = 0").groupBy("query").agg(F.min("key").alias("truth"))
    return features.blend_grid(c.withColumn("mass_score", F.col("s2")).withColumn("score", F.col("s3")), manifest).select(r6(F.col("weight"), "weight"), r6(F.col("mrr"), "mrr"))


@query(f"""WITH g AS (WITH r AS (SELECT c.query, w.w, c.key, m.truth, row_number() OVER (PARTITION BY c.query, w.w ORDER BY w.w * s2 + (1 - w.w) * s3 DESC, c.key) AS r FROM {_CANDIDATES} c JOIN {_TRUE} m USING (query), (SELECT i / 20 AS w FROM range(21) x(i)) w)
    SELECT w AS weight, avg(CASE WHEN r <= 25 THEN 1.0 / r ELSE 0 END) AS mrr FROM r WHERE key = truth GROUP BY w) SELECT round(weight, 6) AS weight, round(mrr, 6) AS mrr FROM g ORDER BY round(mrr, 9) DESC, weight DESC LIMIT 1""")
def best_blend(spark, d):
    """the weight of the best MRR, the larger of equals."""
    c = candidates_of(spark, d)
    manifest = c.filter("n > 1 OR key % 5 = 0").groupBy("query").agg(F.min("key").alias("truth"))
    return features.best_weight(features.blend_grid(c.withColumn("mass_score", F.col("s2")).withColumn("score", F.col("s3")), manifest)).select(r6(F.col("weight"), "weight"), r6(F.col("mrr"), "mrr"))


@query(f"""WITH h AS (SELECT query, channel, key % 200 AS key, min(rank) AS rank FROM {_CHANNELS} GROUP BY ALL), u AS (SELECT query, 'rrf_union' AS channel, key, row_number() OVER (PARTITION BY query ORDER BY round(sum(1 / (60 + rank)), 12) DESC, key) AS rank FROM h GROUP BY query, key),
    b AS (SELECT * FROM h UNION ALL SELECT * FROM u)
    SELECT channel, k::INTEGER AS cutoff, count(*) AS queries, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS recall FROM (SELECT t.query, c.channel, min(r.rank) AS rank FROM {_TRUTH} t CROSS JOIN (SELECT unnest(['a', 'b', 'c', 'rrf_union']) AS channel) c
    LEFT JOIN b r ON r.query = t.query AND r.channel = c.channel AND r.key = t.truth GROUP BY t.query, c.channel), (SELECT unnest([1, 25]) AS k) GROUP BY channel, k""")
def channel_recall(spark, d):
    """Recall of each channel and of their union, fused; every query counts in each."""
    hits = channels_of(spark, d).withColumn("key", F.col("key") % 200)
    return metrics.channel_recall(truth_of(spark, d).select("query", "truth"), hits, [1, 25]).select("channel", "cutoff", "queries", r6(F.col("recall"), "recall"))


@query("SELECT o_orderkey FROM orders ORDER BY substr(md5('7:' || o_orderkey), 1, 16), o_orderkey LIMIT 100")
def seeded_sample(spark, d):
    """100 orders by hash; the same each time."""
    return ranking.hash_sample(t(spark, d, "orders"), 100, "o_orderkey", 7).select("o_orderkey")


@query("""SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(md5('7:' || o_orderkey), 1, 16), o_orderkey) AS r FROM orders) WHERE r <= 3 ORDER BY substr(md5('7:' || o_orderkey), 1, 16), o_orderkey LIMIT 500""")
def capped_sample(spark, d):
    """Three orders of a customer at most, 500 in all, by hash."""
    return retrieval.capped_sample(t(spark, d, "orders"), 3, 500, "o_custkey", "o_orderkey", 7).select("o_orderkey")


@query()
def pointwise_ranker(spark, d):
    """M3, M4, labelled substitute: boosted trees on single candidates, ranked inside their query."""
    rows = frame_of(spark, d).withColumn("target", ((F.col("n") > 1) | (F.col("s2") > 90)).cast("double"))
    names = ["mass_rank", "rank", "candidate_count", "s3", "s1"]
    train = rows.filter(F.pmod(F.xxhash64("query"), F.lit(5)) > 0)
    model = features.pointwise_ranker(train, names, trees=5, depth=3)
    return ranking.ranked(model.transform(rows), ["query"], F.col("ranker_score").desc(), F.col("mass_rank"), name="final_rank").select("query", "key", "final_rank")


#: Of the candidates' columns those that the list-wise ranker learns from.
LEARNT = ["mass_rank", "candidate_count", "s1", "s2", "s3"]


def learning_frame(spark: SparkSession, d: str) -> DataFrame:
    """frame_of with one positive in each query: the candidate with the best of a mix of its columns and a number that the key decides, which no feature tells."""
    odd = F.pmod(F.xxhash64("query", "key"), F.lit(100)) / 100
    hidden = 0.3 * F.log1p("s2") - F.abs(F.col("s3") - 0.04) * 40 + F.col("s1") / 100_000 + odd
    rows = ranking.ranked(frame_of(spark, d), ["query"], hidden.desc(), F.col("key"), name="__true")
    return rows.withColumn("target", (F.col("__true") == 1).cast("int")).drop("__true")


def _listwise(spark: SparkSession, d: str) -> tuple[DataFrame, listwise.Ranker]:
    # Read for the counts, the fit and the ranking, so made once.
    rows = settled(learning_frame(spark, d).select("query", "key", "target", *LEARNT))
    return rows, listwise.fit(rows.filter(F.pmod(F.xxhash64(F.lit(1), "query"), F.lit(5)) > 0), LEARNT, trees=8, depth=3, rate=0.3, least=5)


@query()
def listwise_ranker(spark, d):
    """M3, M4: trees on lambda gradients, fitted on four fifths of the queries; every candidate is ranked."""
    rows, model = _listwise(spark, d)
    return listwise.ranked(rows, model).select("query", "key", F.round("ranker_score", 6).alias("ranker_score"), "final_rank")


@query()
def ranker_importance(spark, d):
    """M4: gain and splits of each feature of the list-wise ranker."""
    _, model = _listwise(spark, d)
    return model.importance(spark).select("feature", F.round("gain", 6).alias("gain"), "splits")


def _bit_network(spark: SparkSession, d: str) -> tuple[DataFrame, network.Network]:
    rows = t(spark, d, "embeddings")
    known = rows.withColumn("bits", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int")))
    return rows, network.fit(known, "vec_id", "embedding", "bits", hidden=(32,), epochs=6, batches=2, rate=0.02)


@query()
def bit_perceptron(spark, d):
    """M1, M2: embeddings predict a one-hot of their label; fitted on all rows but those held out to end the training."""
    rows, net = _bit_network(spark, d)
    return net.predict(rows, "vec_id", "embedding").select("vec_id", F.transform("p", lambda x: F.round(x, 4)).alias("p"))


@query()
def pooled_network(spark, d):
    """The probabilities of four vectors at a time, pooled by confidence."""
    rows, net = _bit_network(spark, d)
    p = net.predict(rows.withColumn("molecule", F.floor(F.col("vec_id") / 4)), "molecule", "embedding")
    return evidence.pooled(p, "molecule", "p", weighted=True).select("molecule", "bit", F.round("p", 4).alias("p"))
