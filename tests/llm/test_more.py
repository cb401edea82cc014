"""Batteries, trees, densities, kernels and parts of groups against plain computations; hot, repeated, null and odd rows."""

import math
import random
import re
import string
import subprocess
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis import store
from affinis.llm import common, docstats, gbt, mixing, qda, secrets, simhash, toxicity

REPO = str(Path(__file__).resolve().parent.parent.parent)
WORDS = "the of and to in is it that was for on are with as this be by from or at".split()
PLAIN = "doc_id long, text string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def tail(z):
    t = 1 / (1 + 0.2316419 * abs(z))
    p = math.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return p if z >= 0 else 1 - p


def plain_battery(token):
    """(length, p) by counting; None where no alphabet fits."""
    a = next((a for _, a in secrets.ALPHABETS if set(token) <= set(a)), None)
    if a is None:
        return None
    k, n, codes = len(a), len(token), [a.index(c) for c in token]
    chi = sum((v - n / k) ** 2 for v in (Counter(codes).get(i, 0) for i in range(k))) / (n / k)
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "0"
    share = [sum(kind(c) == x for c in a) / k for x in "aA0"]
    if max(share) == 1:
        same, kinds = 0.5, ["0" if (c.isdigit() and c < "5") or (c.isalpha() and c.lower() <= "m") else "1" for c in token]
    else:
        same, kinds = sum(s * s for s in share), [kind(c) for c in token]
    turns = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    runs = (turns - (n - 1) * (1 - same)) / math.sqrt((n - 1) * same * (1 - same))
    mid = (k - 1) / 2
    serial = sum((x - mid) * (y - mid) for x, y in zip(codes, codes[1:], strict=False)) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    excess = n * 0.6 * min(4.0, math.sqrt(k) / 2)
    odd = max(abs(runs), abs(serial), (chi - (k - 1)) / math.sqrt(2 * (k - 1)))
    return n, 1.0 if 2 * tail(odd) < 0.002 else tail((k - 1 + excess - chi) / math.sqrt(2 * (k - 1 + 2 * excess)))


def plain_spans(tokens):
    """Of (start, token): those below the weighted Benjamini-Hochberg line."""
    tested = [(s, t, b) for s, t in tokens if (b := plain_battery(t))]
    if not tested:
        return set()
    mean = sum(b[0] for *_, b in tested) / len(tested)
    q = sorted((b[1] * mean / b[0], s, s + len(t)) for s, t, b in tested)
    cut = max((i for i, x in enumerate(q, 1) if x[0] <= 0.01 * i / len(q)), default=0)
    return {(s, e) for _, s, e in q[:cut]}


ENCODINGS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.digits + string.ascii_lowercase, "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_"}


def test_battery_and_false_discovery_control(spark):
    r = random.Random(6)
    texts = []
    for _ in range(60):
        words = [r.choice(WORDS) for _ in range(30)]
        for _ in range(r.randrange(1, 6)):
            kind = r.choice([*ENCODINGS.values(), string.ascii_lowercase, string.digits])
            token = "".join(r.choice(kind if r.random() < 0.7 else "abcab") for _ in range(r.randrange(20, 46)))
            words.insert(r.randrange(len(words)), token)
        texts.append(" ".join(words))
    got = secrets.digest(spark.createDataFrame(list(enumerate(texts)), PLAIN)).collect()
    assert sum("random" in x.spans for x in got) > 10
    for x in got:
        at, tokens = 0, []
        for w in texts[x.doc_id].split(" "):
            if len(w) >= 20 and not re.search("[0-9a-f]{32}", w):  # such runs are base spans
                tokens.append((at, w))
            at += len(w) + 1
        assert {tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s.startswith("random")} == plain_spans(tokens)


def test_planted_keys_are_found(spark):
    """Of keys of 40 characters of each encoding at least 0.9; of long words, paths and names nothing."""
    r = random.Random(8)
    texts = [prose(i, 40) + " " + "".join(r.choice(a) for _ in range(40)) + " " + prose(i + 1, 40) for a in ENCODINGS.values() for i in range(60)]
    got = secrets.digest(spark.createDataFrame(list(enumerate(texts)), PLAIN)).collect()
    for k, name in enumerate(ENCODINGS):
        assert sum(bool(x.spans) for x in got if x.doc_id // 60 == k) >= 54, name
    clean = [prose(i, 30) + " internationalisation/localisationandsoforth Donaudampfschifffahrtsgesellschaft aaaaaaaaaaaaaaaaaaaaaaaaaa 00000000000000000000000000 " + "-" * 40 for i in range(100)]
    assert not any(x.spans for x in secrets.digest(spark.createDataFrame(list(enumerate(clean)), PLAIN)).collect())
    mixed = "GET /reset-password/" + "".join(r.choice(ENCODINGS["base62"]) for _ in range(60)) + " x"  # the signs of both kinds of base64
    assert "random" in secrets.digest(spark.createDataFrame([(1, mixed)], PLAIN)).first().spans


def test_long_tokens_and_many_matches(spark):
    r = random.Random(9)
    long = "x " + "".join(r.choice(ENCODINGS["base62"]) for _ in range(300_000)) + " y"
    many = " ".join(f"{r.getrandbits(128):032x}" for _ in range(20_000))
    rows = {x.doc_id: x for x in secrets.digest(spark.createDataFrame([(1, long), (2, many), (3, "token=abcdefgh " * 20_000)], PLAIN)).collect()}
    assert rows[1].spans == "random:2:300002" and rows[2].n_hex == 20_000 and rows[3].n_assign == 20_000
    assert rows[2].spans == ",".join(f"hex:{33 * i}:{33 * i + 32}" for i in range(20_000))


def walk(trees, t, x):
    i = 0
    for _ in range(trees.depth):
        i = 2 * i + (2 if x[trees.feature[t, i]] > trees.threshold[t, i] else 1)
    return trees.value[t, i]


def test_flat_trees_against_a_walk(spark):
    r = np.random.default_rng(1)
    x = r.random((500, 4))
    m = gbt.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), np.array([1, 0, 0, -1]), trees=12)
    plain = [m.bias + sum(walk(m, t, row) for t in range(12)) for row in x]
    assert np.allclose(m.margin(x), plain)
    # The whole query: statistics, the fitted model and the base rule of each text.
    d = spark.createDataFrame([(i, prose(i, 5 + i % 60) + (" ###" * (i % 9) if i % 2 else "")) for i in range(300)], PLAIN)
    lab = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(300)], "doc_id long, quality int")
    xs, ys = gbt.labelled_features(d, lab, "quality", common.fold(5) != 0, 8000)
    model = gbt.fit(xs, ys, np.array([-1 if f in gbt.FALLING else 0 for f in gbt.FEATURES]))
    texts = {q.doc_id: q.text for q in d.collect()}
    for q in gbt.quality_rules(d, lab).collect():
        base, features = docstats.stats(texts[q.doc_id])
        p = 1 / (1 + math.exp(-(model.bias + sum(walk(model, t, features) for t in range(len(model.value))))))
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert (q.n_words, q.base_failed, q.kept) == (base[0], failed, not failed and q.probability >= 0.5) and q.probability == pytest.approx(p, abs=1e-9)


def test_discriminant_against_the_densities():
    r = np.random.default_rng(2)
    x = np.abs(np.concatenate([r.normal(1, 0.4, (300, len(docstats.FEATURES))), r.normal(1.5, 0.8, (200, len(docstats.FEATURES)))]))
    y = np.r_[np.zeros(300), np.ones(200)]
    m = qda.Discriminant(x, y)
    z = (qda.transform(x) - m.centre) / m.scale
    own = [z[y == k] for k in (0, 1)]
    pooled = sum(np.cov(c.T, bias=True) * len(c) for c in own) / len(z)
    logs = []
    for c in own:
        s = 0.7 * np.cov(c.T, bias=True) + 0.3 * pooled
        s = 0.95 * s + 0.05 * np.trace(s) / len(s) * np.eye(len(s))
        e = z - c.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) + np.linalg.slogdet(s)[1]))
    assert np.allclose(m.difference(x), np.arcsinh(2 * (logs[1] - logs[0]) / 4))
    p = m.score(x)
    assert np.allclose(p, 1 / (1 + np.exp(-np.clip(m.slope * m.difference(x) + m.offset, -30, 30)))) and abs(p.mean() - y.mean()) < 0.01


def plain_kernel(a, b):
    def features(w):
        w = toxicity.letters(w)
        out = Counter()
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < 5:
                out[w[i], w[j], w[k]] += 0.6 ** (k - i - 2)
        size = math.sqrt(sum(v * v for v in out.values()))
        return {t: v / size for t, v in out.items()}

    x, y = features(a), features(b)
    return sum(v * y.get(t, 0) for t, v in x.items())


def test_string_kernel_against_subsequences():
    r = random.Random(3)
    words = [b"idiot", b"idxiot", b"a", b"of", b"the", b"worthless", "été".encode(), *("".join(r.choice("abc") for _ in range(r.randrange(1, 12))).encode() for _ in range(40))]
    phi = toxicity.features([toxicity.letters(w) for w in words]).astype(float)
    for i, j in combinations(range(len(words)), 2):
        assert phi[i] @ phi[j] == pytest.approx(plain_kernel(words[i], words[j]), abs=1e-5)
    onto = phi[:5].T
    assert np.allclose(toxicity.project([toxicity.letters(w) for w in words], onto), phi @ onto, atol=1e-5)


def test_machine_is_at_its_optimum():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 6))
    y = np.sign(x[:, 0] + 0.3 * r.normal(size=400))
    cost = r.random(400) / 400
    parts = [np.c_[x[:150], np.ones(150)], np.c_[x[150:], np.ones(250)]]
    w = toxicity.svm(parts, y, cost, np.zeros(7), block=70)
    a = np.concatenate(parts)
    grad = np.r_[w[:-1], 1e-3 * w[-1]] - 2000 * a.T @ (cost * y * np.maximum(0, 1 - y * (a @ w)))
    assert np.abs(grad).max() < 0.05 * np.abs(w).max()
    assert toxicity.pooled([(3.0, 1), (-0.5, 1), (-2.0, 4), (-1.5, 1)]) == pytest.approx((8 - 0.5 - 1) / 10) and toxicity.pooled([]) == -1


def test_one_inserted_letter_is_caught(spark):
    """Insults planted once each in held-out clean texts, a foreign letter put into them, at a share of false alarms of 5 % or less."""
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(d, lab)
    clean = [r.text for r in d.join(lab.filter("toxic = 0").select("doc_id"), "doc_id").filter(common.fold(4) == 2).filter("length(text) < 20000").select("text").collect()]
    r = random.Random(5)

    def score(text):
        words = Counter(toxicity.tokens(toxicity.lower(text)))
        return m.score(zip(m.margins([toxicity.letters(w) for w in words]).tolist(), words.values(), strict=True))

    alarms = sum(score(t) >= 0.3 for t in clean) / len(clean)
    hits = plain = 0
    for k in range(200):
        word = r.choice(["disgusting", "idiot", "pathetic", "trash", "loser", "worthless", "stupid", "clown", "moron"])
        at = r.randrange(1, len(word))
        text = clean[k].split()
        put = lambda w, text=text: score(" ".join([*text[: len(text) // 2], w, *text[len(text) // 2 :]])) >= 0.3
        hits += put(word[:at] + r.choice(string.ascii_lowercase) + word[at:])
        plain += put(word)
    assert alarms <= 0.05 and hits >= 0.8 * 200 and plain >= 0.95 * 200, (alarms, hits, plain)


@pytest.mark.parametrize("bytes_", [1 << 20, 600])
def test_groups_in_parts_lose_no_link(spark, bytes_):
    """Sets in two hot groups, searched whole and in parts of a few: the same components as all pairs give."""
    r = random.Random(11)
    rows, sets = [], {}
    for g in range(2):
        bases = [r.sample(range(10_000), 20) for _ in range(3)]
        for i in range(60):
            base = list(r.choice(bases))
            for _ in range(r.randrange(4)):
                base[r.randrange(len(base))] = r.randrange(10_000)
            name = g * 1000 + i
            sets[name] = frozenset(base)
            rows.append((g, name, np.unique(np.array(base, np.uint64)).tobytes()))
    df = spark.createDataFrame(rows, "g int, fp long, value binary").repartition(3)
    got = {x.node: x.root for x in simhash.components(simhash.linked(df, ["g"], lambda v: simhash.Sets(v, 0.8), bytes_)).collect()}
    of = {n: n for n in sets}

    def find(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in combinations(sorted(sets), 2):
        if a // 1000 == b // 1000 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            of[max(find(a), find(b))] = min(find(a), find(b))
    assert {n: got.get(n, n) for n in sets} == {n: find(n) for n in sets}


def test_sketches_by_planes():
    r = random.Random(12)
    base = [r.getrandbits(256) for _ in range(5)]
    fps = [b ^ sum(1 << k for k in r.sample(range(256), r.randrange(140))) for b in base for _ in range(40)]
    values = [f.to_bytes(32, "little") for f in fps]
    for group in (values, values[:5]):
        s = simhash.Sketches(group)
        for v in values[:50]:
            want = sum(1 << i for i, g in enumerate(group) if (int.from_bytes(g, "little") ^ int.from_bytes(v, "little")).bit_count() <= simhash.FAR)
            assert s.near(v, (1 << len(group)) - 1) == want


def test_one_row_of_each_component(spark):
    """Null ids, repeated ids and repeated rows: one row stays of each component, by whatever names its rows have."""
    a, b = prose(1, 200), prose(2, 200)
    near = a + " end"
    rows = [(None, a, 1), (None, near, 2), (None, a, 3), (7, b, 4), (7, b, 5), (7, prose(3, 100), 6), (8, prose(3, 100), 7), (None, None, 8), (9, "", 9)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __hash int").repartition(3))
    assert kept.columns == ["doc_id", "text", "__hash"]
    out = kept.collect()
    assert len(out) == 4 and sum(r.text in (a, near) for r in out) == 1 and Counter(r.text for r in out)[b] == 1 and Counter(r.text for r in out)[prose(3, 100)] == 1


def test_repeated_rows_are_dealt_exactly(spark):
    docs = [(5, prose(1, 50), "a", 1)] * 7 + [(i, prose(i, 40), "b", 2) for i in range(10, 40)] + [(None, prose(99, 30), "c", 3)] * 5 + [(None, None, None, 4)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, times int").repartition(4)
    out = mixing.repeated_rows(d)
    assert out.columns == d.columns
    taken = mixing.mix(common.settled(mixing._rows(d, F.xxhash64("text").alias("h"))))
    want = taken.groupBy("doc_id", "h").agg(F.sum(F.col("epochs") + F.when(F.col("part") * 2 > F.col("size"), 1).otherwise(0)).alias("n")).filter("n > 0").collect()
    got = out.groupBy("doc_id", F.xxhash64("text").alias("h")).count().collect()
    assert {(r.doc_id, r.h): r.n for r in want} == {(r.doc_id, r.h): r["count"] for r in got}


def test_bins_are_even_for_any_weights(spark):
    r = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"), F.when(F.col("id") % 3 == 0, 0.05).when(F.col("id") % 3 == 1, 0.33).otherwise(1.0).alias("weight"), F.col("id").cast("string").alias("name"))
    key = -F.log((F.conv(F.substring(F.md5("name"), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)) / F.col("weight")
    counts = F.array(*[F.lit(float({0: 0, 1: 13334, 6: 13333, 19: 13333}.get(i, 0))) for i in range(mixing.CLASSES)])
    sizes = [x["count"] for x in r.groupBy(mixing._bin(key, counts, F.lit(40_000), F.lit(40)).alias("bin")).count().collect()]
    assert len(sizes) >= 38 and max(sizes) < 3000
    order = r.withColumn("key", key).withColumn("bin", mixing._bin(F.col("key"), counts, F.lit(40_000), F.lit(40))).groupBy("bin").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("bin").collect()
    assert all(x.b <= y.a for x, y in zip(order, order[1:], strict=False))


def test_samples_are_bounded_where_ids_repeat(spark):
    d = spark.createDataFrame([(i % 2, prose(i, 30)) for i in range(400)], PLAIN)
    lab = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id long, quality int")
    x, y = gbt.labelled_features(d, lab, "quality", F.lit(True), 5)
    assert len(y) == 2 and sorted(y) == [0, 1]


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Away:
        master, applicationId = "spark://far:7077", "far"

    class Session:
        sparkContext = Away()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

    monkeypatch.setattr(store, "ship", lambda s: s)
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch(Session())


STAGES = "doc_id long, text string, lang string, source string, n_chars long, row string, hits int, times int"


def test_stages_on_nulls_and_nothing(spark, tmp_path):
    """Null, empty, repeated and odd rows, and an empty table, through all stages; the columns stay."""
    from pyspark.sql import DataFrame

    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(77, 60)), (2, None), (3, "")], "item_id long, text string")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, prose(1, 50), "en", "a", 1, "r", 1, 1), (1, prose(1, 50), "en", "a", 1, "r", 1, 1), (None, None, None, None, None, None, None, None), (2, "", "en", None, 0, "r", 2, 2), (3, prose(3, 4000), "en", "b", 3, "r", 3, 3), (4, "x " + prose(77, 60), "en", "b", 3, "r", 3, 3)]
    for data in (rows, []):
        docs: DataFrame = spark.createDataFrame(data, STAGES)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, common.settled(stage(spark, docs, str(tmp_path)))
            if name != "token_output":
                assert docs.columns == before.columns, name
        assert (docs.count() > 0) == bool(data)
        if data:
            ids = {i for r in docs.collect() for i in r.doc_ids}
            assert 4 not in ids and {1, 3} <= ids


def test_the_package_reaches_the_workers_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from affinis.llm import gbt, simhash, tokens, warc
d = s.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
{{}}
print("fine")
"""
    for call in ("assert simhash.near_duplicates(d).count() == 2", "assert tokens.training_order(d).count() == 1", "assert warc.round_trip(d.selectExpr('doc_id AS page_id', 'text AS url', 'text AS html')).count() == 2"):
        done = subprocess.run([sys.executable, "-c", code.format(call)], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
        assert "fine" in done.stdout, done.stderr[-2000:]
