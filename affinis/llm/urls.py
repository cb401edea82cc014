"""URL filters: allow and block rules by host and path, and a logistic regression on hashed character n-grams of both for the rest."""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = "://([^/?#]*)", "://[^/?#]*([^?#]*)"
#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules become branches of one expression; a longer list is an error, none is left out.
MOST_RULES = 1000
#: Lengths of n-grams; hashed places for either part of a url.
GRAMS, PLACES = (3, 4, 5), 1 << 15
#: Rows of the labelled table that are fitted; a larger table is an error.
MOST_LABELLED = 50_000

#: Names for the labelled table: what sites are blocked for, and what others are about.
BLOCKED = "casino poker slots bets betting jackpot lottery roulette gamble wins pills pharma meds viagra diet replica payday loans adult xxx porn escort camgirls dating ads adserver banner popup track tracker click clicks spam farm phish malware warez crack keygen torrent freegift prizes cheap".split()
PLAIN = "news blog docs wiki library school museum garden recipes science history music travel weather health journal forum maps code data river mountain kitchen paper stories theatre chess football railway bridge farmers cheese winter window camera orchestra trackers address".split()
ENDINGS = ("com", "org", "net", "example.com", "example.org", "example.net", "info", "co")
FRONTS = ("", "www.", "m.", "blog.")
PATHS = ("", "/", "/en/{0}", "/fr/{0}.html", "/de/{0}/", "/es/{0}", "/{0}/index.html", "/articles/{0}")
LURES = ("/bonus/{0}", "/win/{0}?click=1", "/promo/free-{0}")
SYLLABLES = "an ar be co de el en fi ga hi in ka la li ma ne on or pa re ri sa se ta th ti to un ve wi".split()


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label) by rule, some 2,400: label 1 for hosts whose names tell of what is blocked, 0 for plain and for invented names. Endings, fronts and paths go round, so they tell nothing but for a few lures."""
    names = [(n, 1) for n in BLOCKED] + [(f"{a}-{b}", 1) for i, a in enumerate(BLOCKED) for b in (BLOCKED[(i * 7 + k * 5 + 3) % len(BLOCKED)] for k in range(8))]
    names += [(f"{a}-{b}", 1) for i, a in enumerate(BLOCKED) for b in (PLAIN[(i * 3 + k * 11) % len(PLAIN)] for k in range(6))]
    names += [(n, 0) for n in PLAIN] + [(f"{a}-{b}", 0) for i, a in enumerate(PLAIN) for b in (PLAIN[(i * 7 + k * 5 + 3) % len(PLAIN)] for k in range(8))]
    names += [(a + b + c, 0) for (i, a), (j, b) in product(enumerate(SYLLABLES), enumerate(SYLLABLES)) for c in (SYLLABLES[(i * 5 + j * 3) % len(SYLLABLES)],)]
    out = []
    for i, (name, label) in enumerate(names):
        paths = PATHS + LURES if label and i % 4 == 0 else PATHS
        out.append((f"https://{FRONTS[i % len(FRONTS)]}{name}.{ENDINGS[(i // 3) % len(ENDINGS)]}{paths[(i // 5) % len(paths)].format(i * 37 % 1000)}", label))
    return out


def host_of(url: Column) -> Column:
    """After the first `://` up to /, ?, # or the end, A-Z lower-cased; empty for null and for urls without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null and for urls without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (of equals the smallest) and its verdict, else null. A rule fits its host and all hosts below it, where the path begins with the rule's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if bad := [r for v, r in rules if v not in ("allow", "block") or "/" not in r]:
        raise ValueError(f"rules need a verdict of allow or block, and a slash: {bad[:5]}")
    rule = verdict = None
    for v, r in sorted(set(rules), key=lambda x: (-len(x[1]), x[1], x[0])):
        at = r.index("/")
        fits = ((host == r[:at]) | host.endswith(f".{r[:at]}")) & path.startswith(r[at:])
        rule, verdict = (F.when(fits, r), F.when(fits, v)) if rule is None else (rule.when(fits, r), verdict.when(fits, v))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def gram_features(rows: DataFrame) -> DataFrame:
    """rows (with __host and __path) and __features: hashed n-grams of either, each part scaled to length 1, so a long path does not outweigh the host."""
    parts = []
    for part in ("__host", "__path"):
        marked = F.concat(F.lit("^"), F.col(part), F.lit("$"))
        rows = rows.withColumn(f"{part}_c", F.split(marked, ""))
        grams = [f"{part}_{n}" for n in GRAMS]
        for n, out in zip(GRAMS, grams, strict=True):
            rows = NGram(n=n, inputCol=f"{part}_c", outputCol=out).transform(rows)
        rows = rows.withColumn(f"{part}_g", F.concat(*grams)).drop(f"{part}_c", *grams)
        rows = HashingTF(numFeatures=PLACES, binary=True, inputCol=f"{part}_g", outputCol=f"{part}_t").transform(rows)
        rows = Normalizer(p=2.0, inputCol=f"{part}_t", outputCol=f"{part}_f").transform(rows).drop(f"{part}_g", f"{part}_t")
        parts.append(f"{part}_f")
    return VectorAssembler(inputCols=parts, outputCol="__features").transform(rows).drop(*parts)


def fit(labelled: DataFrame) -> LogisticRegressionModel | float:
    """The model of a small table (url, label 0 or 1; rows with neither are passed over); where it has one class only, or none, the score that all urls get.

    The table is one partition, so the sums, and with them the scores, are the same each time.
    """
    rows = labelled.select(host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"), F.col("label").cast("double").alias("label")).filter(F.col("label").isin(0.0, 1.0))
    n, share = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    if n > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    if not n or share in (0.0, 1.0):
        return 0.0 if not n else share
    rows = gram_features(rows).coalesce(1).sortWithinPartitions("__host", "__path", "label")
    fitted = LogisticRegression(featuresCol="__features", labelCol="label", regParam=3e-5, standardization=False, maxIter=60).fit(rows)
    # Written and read back, the model goes to the executors without the summary of its training, and the session that hangs on it.
    fitted.save(path := scratch(labelled.sparkSession))
    return LogisticRegressionModel.load(path)


def url_verdicts(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns of pages (of keep, if given) as struct `row`, with host, path, rule, verdict and score of each row.

    pages: url, anything else. verdict is the rule's, else block where the score, the probability of label 1, is at least threshold. Null urls and those without `://` have
    an empty host and path, which fit no rule; repeated rows are judged alike; urls are read whole, however long; an empty table stays empty. The labels are those of labelled_urls()
    unless given.
    """
    spark: SparkSession = pages.sparkSession
    labelled = labelled if labelled is not None else spark.createDataFrame(labelled_urls(), "url string, label int")
    model = fit(labelled)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep or pages.columns]).alias("row"), host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"))
    if isinstance(model, float):
        rows = rows.withColumn("score", F.lit(model))
    else:
        scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__p").transform(gram_features(rows))
        rows = scored.withColumn("score", vector_to_array("__p")[1])
    rule, verdict = ruled(F.col("__host"), F.col("__path"), rules)
    model_says = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("row", F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, model_says).alias("verdict"), "score")
