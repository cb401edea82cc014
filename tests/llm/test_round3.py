"""URL filters and spelling groups against plain versions: nulls, empty and long values, ties, repeated rows, empty tables, extra columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from affinis.llm import spelling, urls

PAGES = "page_id long, url string, host string, score int"


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path, rules):
    fits = [(len(r), r, v) for v, r in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: (x[0], [-ord(c) for c in x[1]]))[1:] if fits else (None, None)


ODD = [None, "", "no url", "http://", "http://WWW.Example.COM/en/x?y=1#z", "http://example.com/EN/x", "https://example.com", "https://xexample.com/en/", "http://a.net/es/1", "http://net/fr/", "ftp://É.ÄB.org/é?q://x", "http://a.example.com:80/en/", "x://y#/en/", "http://a/b://c/d", "http://b.example.com/en/" + "a1/" * 60_000]


def test_url_rules(spark):
    rows = [(i, u, "x", 1) for i, u in enumerate(ODD)]
    got = urls.url_verdicts(spark.createDataFrame([*rows, rows[4]], PAGES)).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert (r.host, r.path) == plain_parts(r.row.url)
        rule, verdict = plain_rule(r.host, r.path, urls.RULES)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
        assert r.row.host == "x" and r.row.score == 1
    assert urls.url_verdicts(spark.createDataFrame([], PAGES)).count() == 0
    own = [("block", "com/"), ("allow", "com/"), ("block", "a.com/b"), ("allow", "b.com/")]
    host, path = urls.ruled(F.col("h"), F.col("p"), own)
    assert [tuple(r) for r in spark.createDataFrame([("a.com", "/b"), ("x.com", "/"), ("com", "")], "h string, p string").select(host, path).collect()] == [("a.com/b", "block"), ("com/", "allow"), (None, None)]
    for bad in ([("deny", "com/")], [("allow", "com")], [("allow", f"{i}/") for i in range(1001)]):
        with pytest.raises(ValueError, match="rules"):
            urls.ruled(F.col("h"), F.col("p"), bad)


def test_url_model(spark):
    """Names put together anew from words of the labelled table, and invented names; the table without a class gives one score."""
    r = random.Random(5)
    bad = [f"http://{r.choice(urls.FRONTS)}{a}{r.randrange(99)}-{b}.org/en/{r.randrange(999)}" for a, b in (r.sample(urls.BLOCKED, 2) for _ in range(150))]
    good = [f"http://{r.choice(urls.FRONTS)}{''.join(r.sample(urls.SYLLABLES, 4))}.org/en/{r.randrange(999)}" for _ in range(150)]
    seen = {u for u, _ in urls.labelled_urls()}
    assert not seen & {*bad, *good}
    rows = spark.createDataFrame([(u, k) for k, us in ((1, bad), (0, good)) for u in us], "url string, k int")
    got = urls.url_verdicts(rows).select("row.k", "verdict", "score").collect()
    assert sum(x.verdict == "block" for x in got if x.k) >= 0.95 * len(bad)
    assert sum(x.verdict == "block" for x in got if not x.k) <= 0.05 * len(good)
    again = urls.url_verdicts(rows.repartition(5)).select("row.k", "verdict", "score").collect()
    assert sorted(again) == sorted(got)
    for labelled, want in (([], 0.0), ([("http://a.org/", 1), (None, None)], 1.0)):
        table = spark.createDataFrame(labelled, "url string, label int")
        assert {x.score for x in urls.url_verdicts(rows, table).collect()} == {want}


def test_url_score_is_the_logistic_of_its_grams(spark):
    table = spark.createDataFrame(urls.labelled_urls(), "url string, label int")
    model, grams = urls.fit(table), lambda s: {s[i : i + n] for n in urls.GRAMS for i in range(len(s) - n + 1)}
    url = "http://m.casino-river.org/en/77"
    row = urls.gram_features(spark.createDataFrame([plain_parts(url)], "__host string, __path string")).first()
    host, path = (len(grams(f"^{x}$")) for x in plain_parts(url))
    values = row["__features"]
    assert math.isclose(sum(v * v for v in values.values), 2.0) and host * 0.98 <= sum(values.indices < urls.PLACES) <= host and path * 0.98 <= sum(values.indices >= urls.PLACES) <= path
    margin = sum(model.coefficients[int(i)] * v for i, v in zip(values.indices, values.values, strict=True)) + model.intercept
    assert math.isclose(urls.url_verdicts(spark.createDataFrame([(url,)], "url string")).first().score, 1 / (1 + math.exp(-margin)), rel_tol=1e-9)


LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_groups(rows, least=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= least and len(w) >= 5}
    near, masked = defaultdict(set), defaultdict(set)
    for w in n:
        for p in range(len(w)):
            shorter = w[:p] + w[p + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
            masked[p, shorter].add(w)
    for g in masked.values():
        for w in g:
            near[w] |= g - {w}
    form = {w: min((-n[x], x) for x in near[w]) for w in n if near[w]}
    form = {w: x for w, (k, x) in form.items() if -k >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def groups(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: tuple(r)[1:] for r in got}


SCHEMA = "doc_id long, text string, word string, n int, node string"


def mixed_rows():
    """Few letters, so that words repeat letters and have many near words; chains of forms; letters beyond ASCII; deep shared prefixes."""
    r = random.Random(3)
    words = ["".join(r.choice("aAbÀÿ") for _ in range(r.randrange(4, 9))) for _ in range(400)]
    words += ["prefix" * 5 + "".join(r.choice("ab") for _ in range(r.randrange(5))) for _ in range(60)]
    chain = [w for k, w in enumerate(("wxyza", "wxyzb", "wxyzbc", "wxyzbcd", "wyzbcd")) for _ in range(3 * 2**k)]
    texts = [None, "", "1 2 3", "aaaaa aaaaaa aaaaaaa", " ".join(words * 3), ", ".join(chain), "É.È_" + "-".join(words[:50]) + " l'éclair éclairs eclair"]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[6], (None, "aaaaa éclair éclair aaaaab", None, None, None)]


def test_spelling_groups(spark):
    rows = mixed_rows()
    got = groups(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    want = plain_groups([r[:2] for r in rows])
    assert got == want and max(v[3] for v in want.values()) > 8
    assert got["wxyza"][1] == "wyzbcd" and sum(v[0] is not None for v in got.values()) > 30
    assert groups(spelling.spelling_groups(spark.createDataFrame([], SCHEMA))) == {}


def test_spelling_of_all_short_words(spark):
    """Every word of two letters up to a length: all siblings, no pair found twice and none left out."""
    words = [f"{i:b}"[1:].replace("0", "a").replace("1", "b") for i in range(2**5, 2**9)]
    rows = [(i, " ".join(words[i:] * 3)) for i in range(2)] + [(9, " ".join(w for k, w in enumerate(words) for _ in range(k % 7)))]
    assert groups(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_groups(rows)


def test_long_runs_and_colliding_nodes(spark, monkeypatch):
    """A run of 300,000 letters is a word like others; where prefixes share a hash the result is the same."""
    run = "".join(random.Random(8).choice("abcdefgh") for _ in range(300_000))
    other = run[:150_000] + "z" + run[150_000:]
    rows = [(1, f"{run} {run} {run} " + f"{other} " * 6)]
    got = groups(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(zlib.crc32(f"1:{w}".encode()) % 97 for w in (run, other))
    assert got == {run: (other, other, 3, 1, 6), other: (None, other, 6, 1, None)}
    monkeypatch.setattr(spelling, "_BASE", spelling.np.uint64(0))  # all nodes deeper than the first letter's fall together
    mixed = mixed_rows()
    assert groups(spelling.spelling_groups(spark.createDataFrame(mixed, SCHEMA))) == plain_groups([r[:2] for r in mixed])


def test_light_edges_are_few(spark):
    rows = [(1, " ".join("".join(random.Random(i).choice("abcd") for _ in range(8)) for i in range(3000)))]
    known = spelling.settled(spelling.words(spark.createDataFrame(rows, "doc_id long, text string"), least_times=1).withColumn("id", F.monotonically_increasing_id()))
    most = spelling.light_edges(known).groupBy("word").count().agg(F.max("count")).first()[0]
    assert most <= math.log2(known.count())


def test_one_text_of_each_id_is_learnt(spark, monkeypatch):
    """50,000 rows of two labelled ids: two of them reach the task that fits."""
    from affinis.llm import toxicity

    rows = spark.range(50_000).selectExpr("id % 2 AS doc_id", "concat('you are ', id, if(id % 2 = 1, ' worthless', ' kind')) AS text")
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, 1), (None, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fold", lambda n, key="doc_id": F.lit(0))
    took = []
    real = toxicity.one_per_id
    monkeypatch.setattr(toxicity, "one_per_id", lambda *a: took.append(real(*a)) or took[-1])
    machine = toxicity.fit(rows, labels, per_class=5)
    assert sorted(r.doc_id for r in took[0].collect()) == [0, 1] and machine.slope >= 0
    assert toxicity.toxicity_scores(rows.limit(10), labels, per_class=5).count() == 10


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark, tmp_path):
    def say(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(urls.SYLLABLES) for _ in range(3)) for _ in range(n))

    rows = [(i, say(i % 20, 80), "en", f"s{i % 3}", 1) for i in range(40)] + [(50, say(90, 5) + " " + say(99, 60), "en", "s0", 1)]
    for name, data, schema in (("documents", rows, DOCS), ("labels", [(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, say(99, 60))], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_stages_can_be_read_at_any_time(spark, corpus):
    """Results of earlier stages stay readable after later ones were built; two chains don't disturb each other."""
    import corpus_pipeline

    chains = []
    for _ in range(2):
        docs, held = spark.read.parquet(f"{corpus}/documents.parquet"), []
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, corpus)
            held.append(docs)
        chains.append(held)
    counts = [[d.count() for d in held] for held in chains]
    assert counts[0] == counts[1] and counts[0][0] == 41 and counts[0][1] == 21 and counts[0][2] == 20 and counts[0][4] > 0


def test_run_leaves_the_shards_and_its_result(spark, corpus, monkeypatch):
    from pathlib import Path

    import corpus_pipeline

    root = Path(spelling.settled(spark.range(1)).inputFiles()[0].removeprefix("file:")).parent.parent
    before = set(root.iterdir())
    out = corpus_pipeline.run(spark, corpus)
    left = set(root.iterdir())
    assert out.count() > 0 and len(left - before) == 2 and sum((p / "manifest.json").exists() for p in left - before) == 1
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", lambda *a: 1 / 0), corpus_pipeline.STAGES[-1]])
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, corpus)
    assert set(root.iterdir()) == left


def test_record_ids_are_unique(spark, tmp_path):
    """Repeated and null page ids: no two records share an id, and a revisit names the one response of its payload."""
    from affinis.llm import warc

    page, other = "<p>" + "x" * 1000, "<p>" + "y" * 1000
    rows = [(7, "u", page), (9, "u", page), (9, "v", "short"), (None, "u", page), (None, "u", page), (7, "u", page), (3, "u", other), (4, "u", other), (4, "u", other), (-2, "u", "z")]
    written = spelling.settled(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), f"file://{tmp_path}"))
    got = warc.read(spark, written).collect()
    assert len(got) == 10 and len({r.record_id for r in got}) == 10
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == sorted([(7, "revisit", 9), (9, "response", 0), (9, "response", 0), (0, "revisit", 9), (0, "revisit", 9), (7, "revisit", 9), (3, "revisit", 4), (4, "response", 0), (4, "response", 0), (-2, "response", 0)])
    heads = [f for p in tmp_path.glob("*.warc.gz") for f, _ in warc.records(p.open("rb"))]
    nine = next(f["warc-record-id"] for f in heads if f.get("x-page-id") == "9" and f["warc-target-uri"] == "u")
    assert {f["warc-refers-to"] for f in heads if f.get("x-page-refers-to") == "9"} == {nine}
    assert [f.get("warc-refers-to") for f in heads if f.get("x-page-refers-to") == "4"] == [None]


def test_texts_with_too_few_grams_are_left_out_early():
    from affinis.llm import decontam

    item = " ".join("".join(random.Random(i).choice("abcdefgh") for _ in range(7)) for i in range(12)).encode()
    items = decontam.Items([(1, item), (2, b"abc")])
    assert items.needed == items.least[0] > 1
    part, whole = item[:20], b"x " + item + b" y"
    data = part + b"\0" * 9 + whole
    _, _, text = items.hits(data, decontam.np.array([0, len(part) + 9]))
    assert set(text.tolist()) == {1} and decontam.Items([(2, b"abc")]).needed == 1


def test_pattern_splits_as_the_published_one():
    """Tokens of odd texts are those of the pattern as published."""
    import tiktoken

    from affinis.llm import tokens

    ours, end = tokens.encoder(tokens.VOCABULARY)
    published = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    plain = tiktoken.Encoding("published", pat_str=published, mergeable_ranks=ours._mergeable_ranks, special_tokens={})
    r = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\x0b", "\x85", "'", "'s", "'ll", "'re", "'l", "'D", "''m", "a", "Ünï", "日本", "é", "12", "٣", "½", "...", "-", "_", "\U0001f600", "\x00", "​"]
    texts = ["", " ", "\n\n", " a ", "it's  we'll \n", *("".join(r.choices(parts, k=r.randrange(1, 40))) for _ in range(5000))]
    assert [ours.encode_ordinary(t) for t in texts] == [plain.encode_ordinary(t) for t in texts]
