"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontam, gbt, mixing, qda, secrets, simhash, spelling, tokens, toxicity, urls, warc
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gbt.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=None).select("doc_id", "fingerprint", "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.training_order(table(spark, sf_dir, "documents")).drop("path")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted), least_edits for each document."""
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select("row.doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["edits"])).alias("least_edits"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"]).select("row.doc_id", "held_out", "score", "predicted")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), keep=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict", "score")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11_url_filters gives by rules alone, which SQL can express."""
    return op11_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_secrets gives by patterns alone, which SQL can express."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_quality_rules gives without the model, which SQL can express."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", *gbt.BASE, "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_lm, op3_quality_rules, op4_simhash, op5_quality_classifier, op6_token_ids, op7_decontamination, op8_mixing, op9_warc, op10_toxicity, op11_url_filters, op12_spelling, base_secrets, base_statistics, base_url_rules)}

#: The patterns of op1 for SQL, quotes doubled.
_PATTERNS = tuple((k, p.replace("'", "''")) for k, p in zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX), strict=False))

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                     greatest(0.05, CASE WHEN length(coalesce(text, '')) > 0 THEN 1 - (length(text) - length(translate(text, '#*$%&|<>!', ''))) / length(text) ELSE 0.05 END) AS weight,
                     (('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
        s AS (SELECT source, sum(size)::DOUBLE AS total, 2.0 * sum(size)::DOUBLE AS cap, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
        l AS (SELECT *, (1.5 * sum(total) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
              FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        h AS (SELECT arg_min(level, cap / w) AS held FROM l WHERE level * w <= cap),
        t AS (SELECT source, total, coalesce(least(cap, held * w), cap) AS target FROM l LEFT JOIN h ON true),
        b AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs FROM t),
        r AS (SELECT doc_id, size, total, target, epochs, round(target - epochs * total) AS budget,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size::BIGINT AS size, total::BIGINT AS source_size, target, (epochs * size + least(size, greatest(0, budget - run)))::BIGINT AS taken FROM r
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM m
    """,
    "op12_spelling": rf"""
        WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))),
        r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
        g AS (SELECT d, run, count(*) AS k FROM r WHERE length(run) >= 5 GROUP BY d, run),
        b AS (SELECT run, k, list_transform(range(octet_length(encode(d || ':' || run))), lambda j: ('0x' || substr(hex(encode(d || ':' || run)), 2 * j + 1, 2))::BIGINT) AS bytes FROM g),
        h AS (SELECT run, k, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, tab),
        w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
        v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        p AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        near AS (SELECT a.word, b.word AS other, b.n FROM p a JOIN p b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT p.word, v.word, v.n FROM p JOIN v ON p.rest = v.word UNION SELECT v.word, p.word, p.n FROM p JOIN v ON p.rest = v.word),
        m AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'w': other}}) AS best FROM near GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * v.n THEN best.w END AS form, CASE WHEN -best.n >= 2 * v.n THEN -best.n END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
        c(word, root, step) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, coalesce(l.root, f.word) AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) l ON l.word = f.word
    """,
    "base_url_rules": f"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{urls.HOST}', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(coalesce(url, ''), '{urls.PATH}', 1) AS path FROM pages),
        r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS s FROM (VALUES {", ".join(f"('{v}', '{r}')" for v, r in urls.RULES)}) t(verdict, rule)),
        b AS (SELECT page_id, max({{'n': length(rule), 'rule': rule, 'verdict': verdict}}) AS best FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
        SELECT p.page_id, host, path, best.rule AS rule, best.verdict AS verdict FROM p LEFT JOIN b ON b.page_id = p.page_id
    """,
    "base_secrets": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{k}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for i, (k, p) in enumerate(_PATTERNS))}),
        s AS (SELECT *, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM m WHERE len(m) > 0),
        p AS (SELECT doc_id, o, kind, x, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS a FROM s),
        q AS (SELECT *, a + length(x) AS e FROM p WHERE o > 0 OR length(regexp_extract(x, '{_PATTERNS[0][1]}', 2)) >= 8)
        SELECT d.doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, sha256(coalesce(string_agg(kind || ':' || a::BIGINT || ':' || e::BIGINT, ',' ORDER BY a, o), '')) AS base_sha256 FROM d LEFT JOIN q ON d.doc_id = q.doc_id GROUP BY d.doc_id
    """,
    "base_statistics": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5),
        r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x), c AS (SELECT doc_id, count(DISTINCT p + k) AS again FROM r, range(5) y(k) WHERE n > 1 GROUP BY doc_id),
        a AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words
              FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id)
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a
    """,
}
