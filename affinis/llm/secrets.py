"""Secret scans: patterns, and a battery of randomness tests over tokens; DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run of either cannot hold a longer one, so the least length may stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
LEAST_VALUE = 8
#: What the battery looks at: runs of letters, digits and the signs of base64, 20 at least.
#: FILL stands for what is taken already: a run that touches it is none of the battery's. A text's own FILL counts alike.
FILL, LEAST_TOKEN = "\U0010ffff", 20
TOKEN = r"(?<![A-Za-z0-9+/_\-\x{10ffff}])[A-Za-z0-9+/_-]{20,}+(?!\x{10ffff})"
#: Runs with the signs of both kinds of base64 are parted at those of one of them.
PARTS = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}")
#: Matches whose places are summed in one go.
RUN = 256
#: The alphabets in the order in which an encoding is inferred.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("small", "abcdefghijklmnopqrstuvwxyz"),
    ("capital", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: The alternative that a token must be told from: what prose, identifiers and paths deviate by, per character.
PROSE_SHARE = 0.6
_SMALL = "abcdefghijklmnopqrstuvwxyz"
FDR = 0.01
UNIFORM = 0.002


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches: code points, end exclusive.

    Splitting at the pattern gives what stands between the matches, so lengths alone place them. Lengths are summed in runs of
    RUN matches, and the runs laid end to end, so that the work grows with the number of matches and not with its square.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    empty = F.expr("cast(array() as array<struct<s: int, e: int, m: string>>)")

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + pair["g"]
        e = s + F.length(pair["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m")))).alias("out"))

    def place(m: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.struct(g.alias("g"), x.alias("m")))
        return let(pairs, lambda p: let(F.transform(in_runs(p), lambda r: F.aggregate(r, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)), lay))

    def lay(runs: Column) -> Column:
        before = F.aggregate(
            runs,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
            lambda acc: acc["all"],
        )
        moved = lambda r, o: F.transform(r["out"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e"), x["m"].alias("m")))
        return F.flatten(F.zip_with(runs, before, moved))

    return F.when(F.rlike(text, F.lit(pattern)), let(matches, place)).otherwise(empty)


def in_runs(a: Column) -> Column:
    """The array's elements in runs of RUN."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda k: F.slice(a, k * RUN + 1, F.lit(RUN)))


def masked(text: Column, pattern: str, holds=None) -> Column:
    """text with as many FILL in place of each match for which holds is true (all by default)."""

    def fill(m: Column) -> Column:
        over = F.repeat(F.lit(FILL), F.length(m))
        return over if holds is None else F.when(holds(m), over).otherwise(m)

    def join(x: Column) -> Column:
        n = F.size(x["m"])
        return F.array_join(F.concat(F.zip_with(F.slice(x["g"], F.lit(1), n), x["m"], lambda g, m: F.concat(g, fill(m))), F.slice(x["g"], n + 1, F.lit(1))), "")

    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(F.rlike(text, F.lit(pattern)), let(parts, join)).otherwise(text)


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def alphabet(token: Column) -> Column:
    """The first alphabet that has all the token's characters; null if none has."""
    out = F.lit(None).cast("string")
    for _, letters in reversed(ALPHABETS):
        out = F.when(F.length(F.translate(token, letters, "")) == 0, F.lit(letters)).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """struct<n, p>: the token's length, and the p-value of its being as even as it is although it is prose-like; null where no encoding fits.

    Three statistics are z-scores under uniform letters: chi-squared over the alphabet, runs of like characters, lag-one
    correlation. Under the alternative chi-squared grows by PROSE_SHARE (alphabet - 1 at most) for each character, so the same
    excess tells more of a longer token: that is the length-aware part. p is the chance of a chi-squared as low as found under the
    alternative; it is 1 if any of the three statistics rejects uniform letters at the level UNIFORM.
    """

    def tested(a: Column) -> Column:
        k = F.length(a)
        codes = F.transform(F.split(token, "", -1), lambda c: F.instr(a, c) - 1)
        times = F.transform(F.split(a, "", -1), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"))
        # Runs are of capitals, small letters, and digits and signs; in an alphabet of one of these alone, of its lower and upper half.
        share = [(k - F.length(F.translate(a, x, ""))) / k for x in (_SMALL, _SMALL.upper())]
        share.append(1 - share[0] - share[1])
        alone = F.greatest(*share) == 1
        same = F.when(alone, 0.5).otherwise(share[0] * share[0] + share[1] * share[1] + share[2] * share[2])
        halves = F.translate(token, "0123456789" + _SMALL + _SMALL.upper(), "0" * 5 + "1" * 5 + ("0" * 13 + "1" * 13) * 2)
        kinds = F.when(alone, halves).otherwise(F.translate(F.translate(token, _SMALL, "a" * 26), _SMALL.upper() + "0123456789+/-_", "A" * 26 + "0" * 14))
        turns = F.regexp_count(kinds, F.lit("a+|A+|0+|1+")) - 1
        return let(F.struct(k.cast("double").alias("k"), codes.alias("c"), times.alias("times"), F.length(token).cast("double").alias("n"), same.alias("same"), turns.cast("double").alias("turns")), scored)

    def scored(x: Column) -> Column:
        k, n, turns = x["k"], x["n"], x["turns"]
        squares = F.aggregate(x["times"], F.lit(0.0), lambda acc, v: acc + v * v)
        chi = k / n * squares - n
        middle = (k - 1) / 2
        # The element before goes along, so that a single pass sees each pair of neighbours.
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last"))
        product = F.aggregate(x["c"], start, lambda acc, v: F.struct((acc["sum"] + acc["last"] * (v - middle)).alias("sum"), (v - middle).alias("last")), lambda acc: acc["sum"])
        variance = (k * k - 1) / 12
        stats = F.struct(chi.alias("chi"), k.alias("k"), n.alias("n"), ((turns - (n - 1) * (1 - x["same"])) / F.sqrt((n - 1) * x["same"] * (1 - x["same"]))).alias("runs"), (product / (variance * F.sqrt(n - 1))).alias("serial"))
        return let(stats, combined)

    def combined(x: Column) -> Column:
        k, n = x["k"], x["n"]
        excess = n * PROSE_SHARE * F.least(F.lit(4.0), F.sqrt(k) / 2)
        # Non-central chi-squared by its first two moments.
        far = (k - 1 + excess - x["chi"]) / F.sqrt(2 * (k - 1 + 2 * excess))
        odd = F.greatest(F.abs(x["runs"]), F.abs(x["serial"]), (x["chi"] - (k - 1)) / F.sqrt(2 * (k - 1)))
        return F.struct(n.cast("int").alias("n"), F.when(2 * normal_tail(odd) < UNIFORM, 1.0).otherwise(normal_tail(far)).alias("p"))

    return let(alphabet(token), lambda a: F.when(a.isNotNull(), tested(a)))


def pieces(c: Column) -> Column:
    """The run as it is; one with the signs of both kinds of base64 is parted at those that leave the longest part."""

    def parted(x: Column) -> Column:
        longest = lambda a: F.coalesce(F.array_max(F.transform(a, lambda p: p["e"] - p["s"])), F.lit(0))
        best = F.when(longest(x["a"]) >= longest(x["b"]), x["a"]).otherwise(x["b"])
        return F.transform(best, lambda p: F.struct((c["s"] + p["s"]).alias("s"), (c["s"] + p["e"]).alias("e"), p["m"].alias("m")))

    both = F.rlike(c["m"], F.lit("[+/]")) & F.rlike(c["m"], F.lit("[_-]"))
    return F.when(both, let(F.struct(*[found(c["m"], p).alias(n) for n, p in zip("ab", PARTS, strict=True)]), parted)).otherwise(F.array(c))


def random_spans(text: Column) -> Column:
    """array<struct<s, e>> of the tokens called random. text: with FILL in place of the spans already found.

    The battery's p-values of a text's tokens, each in the first alphabet that fits it, go through a weighted
    Benjamini-Hochberg step: weights are lengths over their mean, p below FDR * weight * rank / tokens.
    """
    tokens = F.flatten(F.transform(found(text, TOKEN), pieces))
    tested = F.filter(F.transform(tokens, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), battery(c["m"]).alias("b"))), lambda c: c["b"].isNotNull())

    def controlled(t: Column) -> Column:
        mean = F.aggregate(t, F.lit(0.0), lambda acc, c: acc + c["b"]["n"]) / F.size(t)
        weighed = lambda w: F.array_sort(F.transform(t, lambda c: F.struct((c["b"]["p"] * w / c["b"]["n"]).alias("q"), c["s"].alias("s"), c["e"].alias("e"))))
        cut = lambda w: F.aggregate(F.sequence(F.lit(1), F.size(w)), F.lit(0), lambda acc, i: F.when(F.element_at(w, i)["q"] <= FDR * i / F.size(w), i).otherwise(acc))
        return let(let(mean, weighed), lambda w: F.transform(F.slice(w, F.lit(1), cut(w)), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))))

    empty = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    return let(tested, lambda t: F.when(F.size(t) > 0, controlled(t)).otherwise(empty))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of s, o, e: start, place of the kind in KINDS, end) of each row of docs, sorted.

    A null text counts as empty and has no spans. Repeated rows are scanned alike; other columns are left aside; each row is
    scanned by itself, without a shuffle. Texts are scanned whole, in time that grows with their length, whether they have very long tokens
    or very many matches.
    """
    kind = lambda a, o: F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["e"].alias("e")))
    text = F.col("text")
    holds = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    base = F.concat(kind(F.filter(found(text, ASSIGN), lambda x: holds(x["m"])), 0), kind(found(text, ACCESS), 1), kind(found(text, HEX), 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("base", F.array_sort(base))
    # Without a base span no pattern has anything to take out; with one, each step's text is made once for the next.
    free = let(masked(text, ASSIGN, holds), lambda t: let(masked(t, ACCESS), lambda u: masked(u, HEX)))
    free = rows.select("doc_id", "base", F.when(F.size("base") > 0, free).otherwise(text).alias("text"))
    return free.select("doc_id", "base", F.array_sort(F.concat("base", kind(random_spans(text), 3))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    count = lambda o: F.size(F.filter("base", lambda x: x["o"] == o)).cast("long")
    return secret_scan(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.encode(listed(F.col("base")), "utf-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
