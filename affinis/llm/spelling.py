"""Spelling variants: words one edit apart, by merging the light subtrees of a trie into heavy paths, and the commoner form each goes to.

The trie of all words is never built as a tree. A node is a depth and a hash of the letters up to there, an edge is a node and its next letter,
and sizes of subtrees are counts of equal edges, so Spark's grouping and joins do the work. At each node the largest child is heavy and
goes on; a word leaves heavy edges at most log2(words) times, and only there, in the smaller subtree, is it altered: the letter of the light edge is
replaced by the heavy one, skipped, or preceded by the heavy one. Where that meets a word, its terminal coincides with one of the larger subtree.
Light siblings that agree in all but that letter are merged with one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import settled

#: Letters of a run; its letters of ASCII are lower-cased, no others.
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many, by its hash, loses a letter.
THINNED = 97
#: Nodes of these depths are few: no more than the letters allow, 1 + 90 + 90 * 90.
SHALLOW = 2
#: Forms of forms end after fewer than 2 ** ROUNDS steps, as each step at least doubles a count of 64 bits.
ROUNDS = 6
#: Letters that a worker lays out at a time; a longer word comes alone.
LETTERS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(docs: DataFrame, least_chars: int = 5, least_times: int = 3) -> DataFrame:
    """word and n: what the runs of whole texts give, of least_chars code points, found least_times in all.

    A run whose crc32 of `<doc_id>:<run>` divides by THINNED loses the code point at that hash modulo its length. A null text has no runs, a null
    id counts as empty text. Counted at the map side first, so a common word is no hot key.
    """
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).alias("run"))
    # A run that may lose a letter must have one more.
    runs = runs.filter(F.length("run") >= least_chars).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % THINNED == 0, without("run", at)).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).filter(F.length("word") >= least_chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_times)


def without(word: str, at: Column) -> Column:
    """word without the code point at a place that counts from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def replaced(word: str, at: Column, letter: str) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.col(letter), F.substring(word, at + 2, F.length(word)))


def preceded(word: str, at: Column, letter: str) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.col(letter), F.substring(word, at + 1, F.length(word)))


def edges(known: DataFrame) -> DataFrame:
    """id, depth, node, next for each place of each word (id, word): next is the code point there, 0 behind the last one.

    What a word takes grows with its length alone. Two prefixes with one hash only share a heavy letter, which may be any, so results don't depend on hashes.
    """
    ship(known.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("depth", pa.int32()), ("node", pa.int64()), ("next", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(batch):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + LETTERS, side="right")))
                yield _edges(batch.slice(first, last - first), schema)
                first = last

    return known.select("id", "word").mapInArrow(work, "id long, depth int, node long, next int")


def _edges(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    texts = batch.column("word").to_pylist()
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    place = np.arange(len(code)) - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64))
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * power[place], dtype=np.uint64)])
    rows = size + 1
    depth = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    at = np.repeat(start, rows) + depth
    node = (total[at] - np.repeat(total[start], rows)).view(np.int64)
    behind = depth == np.repeat(size, rows)
    following = np.where(behind, 0, np.append(code, 0)[at]).astype(np.int32)
    ids = np.repeat(batch.column("id").to_numpy(), rows)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(depth.astype(np.int32)), pa.array(node), pa.array(following)], schema=schema)


def light_edges(known: DataFrame) -> DataFrame:
    """word, n, depth, heavy (the letter of the largest child) for each place where a word leaves the heavy path: at most log2(words) rows for a word.

    Every word passes the shallow nodes, which are few by their depth and are broadcast. The others are joined by merging, where Spark splits a prefix that many words share.
    """
    rows = edges(known)
    sizes = rows.groupBy("depth", "node", "next").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("depth", "node").agg(F.max(F.struct("n", "next")).alias("b"), F.count(F.lit(1)).alias("children"))
    heavy = settled(largest.filter("children > 1").select("depth", "node", F.col("b.next").alias("heavy")))
    at = ["depth", "node"]
    top = rows.filter(F.col("depth") <= SHALLOW).join(F.broadcast(heavy.filter(F.col("depth") <= SHALLOW)), at)
    deep = rows.filter(F.col("depth") > SHALLOW).join(heavy.filter(F.col("depth") > SHALLOW).hint("merge"), at)
    light = top.unionByName(deep).filter("next <> heavy").select("id", "depth", F.when(F.col("heavy") > 0, F.char("heavy")).alias("heavy"))
    return known.join(light, "id").select("word", "n", "depth", "heavy")


def near_words(known: DataFrame) -> DataFrame:
    """word, n_near, best (of its near words -n and word, the least): one row for each word with a near word. known: id, word, n, settled.

    A pair is found once, at the node where its words part: in the smaller subtree, by the light word of the two, or among light siblings. These are merged as groups no
    larger than the alphabet, in which each word gets the best of the others, so their pairs are not written out.
    """
    light = settled(light_edges(known))
    size, at = F.length("word"), F.col("depth")
    inside, other = at < size, F.col("heavy").isNotNull()
    # A skipped letter that the next one repeats is skipped at the last of the run, where the words part.
    parts = F.substring("word", at + 1, F.lit(1)) != F.substring("word", at + 2, F.lit(1))
    altered = F.array(F.when(inside & other, replaced("word", at, "heavy")), F.when(inside & parts, without("word", at)), F.when(other, preceded("word", at, "heavy")))
    asked = light.select("word", "n", F.explode(F.filter(altered, lambda x: x.isNotNull())).alias("other"))
    met = asked.join(known.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.explode(F.array(F.struct("word", F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("best")), F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("best"))))
    found = met.select(both.alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")
    rest = F.concat(F.substring("word", F.lit(1), at), F.lit(" "), F.substring("word", at + 2, size))  # no word has a space
    alike = light.filter(inside).groupBy(rest.alias("rest")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all")).filter("size(all) > 1")
    merged = alike.select(F.size("all").cast("long").alias("size"), F.slice("all", 1, 2).alias("top"), F.explode("all").alias("x"))
    merged = merged.select("x.word", (F.col("size") - 1).alias("near"), F.when(F.col("x.word") == F.col("top")[0]["word"], F.col("top")[1]).otherwise(F.col("top")[0]).alias("best"))
    return found.unionByName(merged).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(linked: DataFrame) -> DataFrame:
    """word and root of each word (word, form) that has a form: forms followed to the last. Each round doubles the steps that are known."""
    reached = settled(linked.select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        reached = settled(reached.select("word", "root").join(onward.select("root", "onward"), "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        if reached.filter("moved").isEmpty():
            break
    return reached.select("word", "root")


def spelling_groups(docs: DataFrame, least_chars: int = 5, least_times: int = 3, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text); see words().

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word of largest n (the smallest in code-point
    order of equals) where that is at least factor times the word's; root is the last of its forms. Null texts and empty tables have no words; repeated rows count each
    time; of very long texts all is read, and a run of any length is a word; other columns of docs are not looked at.
    """
    known = settled(words(docs, least_chars, least_times).withColumn("id", F.monotonically_increasing_id()))  # the numbers hold once they are written
    best = known.select("word", "n").join(near_words(known), "word", "left")
    is_form = -F.col("best.n") >= factor * F.col("n")
    grouped = settled(best.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.n")).alias("form_n")))
    last = roots(grouped.filter("form is not null"))
    return grouped.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
