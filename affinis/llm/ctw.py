"""LM scoring: context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fold, portions, settled

#: Bytes of context. A key is the context and the byte that follows it, first byte highest.
DEPTH = 5
#: Text whose distinct keys one task holds.
CHUNK_BYTES = 32 << 20
#: Codes the end of a text; no byte of UTF-8.
END = b"\xff"


def lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def keys(texts: list[bytes]) -> np.ndarray:
    """The key of every byte of the texts; a text begins after DEPTH zero bytes."""
    pad = bytes(DEPTH)
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    n = len(data) - DEPTH
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(DEPTH + 1):
        out <<= np.uint64(8)
        out |= data[k : k + n]
    own = np.ones(n, bool)
    at = 0
    for t in texts[:-1]:
        at += len(t)
        own[at : at + DEPTH] = False  # the padding between two texts is no text
        at += DEPTH
    return out[own]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for arguments of at least one half."""
    shift = np.zeros_like(x)
    y = x.astype(float)
    for _ in range(7):
        small = y < 7
        shift = shift + np.where(small, np.log(np.where(small, y, 1)), 0)
        y = y + small
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def nodes(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, n0, n1, inverse): the bit nodes of contexts. A node's key is context * 256 + the bits so far behind a one; inverse is (keys, 8)."""
    prefix = np.stack([(np.int64(1) << b) | (byte >> (8 - b)) for b in range(8)], axis=1)
    bit = np.stack([byte >> (7 - b) & 1 for b in range(8)], axis=1)
    node, inverse = np.unique((context[:, None] << 8 | prefix).ravel(), return_inverse=True)
    weight = np.repeat(count, 8).astype(float)
    ones = np.bincount(inverse, weight * bit.ravel(), len(node))
    return node, np.bincount(inverse, weight, len(node)) - ones, ones, inverse.reshape(-1, 8)


def mix(log_own: np.ndarray, log_below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, half of each; and the weight of the own estimate."""
    whole = np.logaddexp(log_own, log_below) - math.log(2)
    return whole, np.exp(log_own - math.log(2) - whole)


def tree(key: np.ndarray, count: np.ndarray, floor: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(keys, 8) probabilities of each key's bits, mixed over the context depths floor to DEPTH; and the depth-floor nodes (node, n0, n1, log weighted).

    All keys that share the floor last context bytes must be present. A context never trained on has estimates of one half.
    """
    key = key.astype(np.int64)
    byte = key & 255
    levels = []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for depth in range(DEPTH, floor - 1, -1):
        context = key >> 8 & ((1 << 8 * depth) - 1)
        node, n0, n1, inverse = nodes(context, byte, count)
        own = estimate(n0, n1)
        if below is None:
            whole, weight = own, np.ones(len(node))
        else:
            lower_node, lower_whole = below
            parent = (lower_node >> 8 & ((1 << 8 * depth) - 1)) << 8 | lower_node & 255
            whole, weight = mix(own, np.bincount(np.searchsorted(node, parent), lower_whole, len(node)))
        below = (node, whole)
        levels.append((inverse, n0, n1, weight))
    bit = np.stack([byte >> (7 - b) & 1 for b in range(8)], axis=1)
    p = None
    for inverse, n0, n1, weight in levels:
        here = (np.where(bit == 1, n1[inverse], n0[inverse]) + 0.5) / (n0 + n1 + 1.0)[inverse]
        p = here if p is None else weight[inverse] * here + (1 - weight[inverse]) * p
    return p, (*below, n0, n1)


class Finder:
    """Places of keys in a sorted array: a hash table holds one key for each slot, the few others are searched for."""

    def __init__(self, sorted_keys: np.ndarray):
        self.keys = sorted_keys
        self.shift = np.uint64(64 - max(10, len(sorted_keys).bit_length() + 2))
        self.table = np.zeros(1 << int(64 - self.shift), np.int32)
        self.table[self._slot(sorted_keys)] = np.arange(len(sorted_keys))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(key)]
        if len(other := np.flatnonzero(self.keys[at] != key) if len(self.keys) else ()):
            at[other] = np.searchsorted(self.keys, key[other])
        return at


#: Depth of the subtrees that are built apart: they share their last three context bytes, so none has more than 2 ** 24 keys.
SPLIT = 3
#: Keys of whole subtrees that a task builds at once.
BUILD_KEYS = 1 << 19


def parents(node: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of `depth` above nodes one deeper: the same beginning of a byte, the context without its first byte."""
    return (node >> 8 & ((1 << 8 * depth) - 1)) << 8 | node & 255


def along(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, weight, own): for each byte after the one context of the nodes, the weights and the own estimates of its eight bits. suffix: context and byte."""
    context, prefix = int(node[0]) >> 8, node & 255
    zeros, ones, share = np.zeros(256), np.zeros(256), np.ones(256)
    zeros[prefix], ones[prefix], share[prefix] = n0, n1, weight
    byte = ((prefix[prefix >= 128] & 127)[:, None] * 2 + np.arange(2)).ravel()
    at = np.stack([(1 << b) | (byte >> (8 - b)) for b in range(8)], axis=1)
    bit = np.stack([byte >> (7 - b) & 1 for b in range(8)], axis=1)
    own = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros + ones + 1.0)[at]
    return context << 8 | byte, share[at], own


def top(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """Weights and estimates of the nodes of depth 1 and 0, from the depth-2 nodes summed by their parents (node, n0, n1, whole), of which depth 1 has at most 2 ** 16."""
    node, n0, n1, below = (rows[c].to_numpy() for c in ("node", "n0", "n1", "whole"))
    out = {}
    for depth in (1, 0):
        up = (node >> 8 & ((1 << 8 * depth) - 1)) << 8 | node & 255 if depth < 1 else node
        size = 1 << 8 * (depth + 1)
        a, b = np.bincount(up, n0, size), np.bincount(up, n1, size)
        whole, weight = mix(estimate(a, b), np.bincount(up, below, size))
        out |= {f"n0_{depth}": a, f"n1_{depth}": b, f"w_{depth}": weight}
        node, n0, n1, below = np.arange(size), a, b, whole
    return out


def score_bits(p: np.ndarray, last: np.ndarray, byte: np.ndarray, upper: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of bytes after the context byte `last`, from their bit probabilities p at depth 2."""
    total = np.zeros(len(byte))
    for b in range(8):
        prefix, bit = (1 << b) | (byte >> (8 - b)), byte >> (7 - b) & 1
        q = p[:, b]
        for depth, at in ((1, last << 8 | prefix), (0, prefix)):
            n0, n1, w = (upper[f"{x}_{depth}"][at] for x in ("n0", "n1", "w"))
            q = w * (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0) + (1 - w) * q
        total += np.log10(q)
    return total


def once(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out, h) with each row once in a partition, and times 0; then, for rows that the partition repeats, h and times, the text null.

    A text that fills a third of the table so comes to its chunk once from each partition.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("held_out", pa.bool_()), ("h", pa.int64()), ("times", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            keep = []
            for i, h in enumerate(batch.column("h").to_pylist()):
                if h in seen:
                    seen[h] += 1
                else:
                    seen[h] = 0
                    keep.append(i)
            part = batch if len(keep) == len(batch) else batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.zeros(len(part), np.int64))], schema=schema)
        again = [(h, n) for h, n in seen.items() if n]
        if again:
            k = len(again)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, f.type) for f in list(schema)[:3]), *(pa.array(x, pa.int64()) for x in zip(*again, strict=True))], schema=schema)

    return docs.mapInArrow(work, "doc_id long, text string, held_out boolean, h long, times long")


def counted(texts: list[bytes], times: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the texts and how often they occur, each text so many times."""
    found = [np.unique(keys([t + END for t, n in zip(texts, times, strict=True) if n == 1]), return_counts=True)] if 1 in times else []
    for t, n in zip(texts, times, strict=True):
        if n != 1:
            key, k = np.unique(keys([t + END]), return_counts=True)
            found.append((key, k * n))
    return summed(found)


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([x for _, x in found] or [np.zeros(0)]), len(key)).astype(np.int64)


def lm_scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs.

    Trained on the documents whose crc32 of the id is not 2 modulo 7. A text is its bytes and an end, so the probabilities of all texts sum to 1.
    Texts are dealt into chunks by the hash of id and text; a chunk counts its distinct keys and words once, so what is shuffled
    are counts, not occurrences. Keys are summed over all chunks; subtrees of the context tree are built apart, by their last three context
    bytes, and the nodes of depth 2 joined to them; each chunk gets back the values of its own keys and words, then reads its texts in portions and scores them. Nothing is
    cut off: the model grows with the corpus, and no part of it is broadcast but the estimates of depths 1 and 0, of fixed size.
    Null texts count as empty: one token (the end), and the end alone is coded. Repeated rows count, and are scored, each time. Very long texts
    are read whole; a text is never split between tasks. Other columns are left aside; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    docs = docs.select(id_.alias("doc_id"), text.alias("text"), (fold(7) == 2).alias("held_out"), F.xxhash64(id_, text).alias("h"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_chunks = max(1, math.ceil(size / chunk_bytes))
    dealt = once(docs).withColumn("chunk", F.pmod("h", F.lit(n_chunks)).cast("int"))
    found = pa.schema([("chunk", pa.int32()), ("key", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, more, words, untrained, sums = None, {}, Counter(), set(), []
        for batch, texts in portions(batches):
            chunk = batch.column("chunk")[0]
            times = _times(batch, more)
            rows = [(lower(t), 0 if held else n, n) for t, n, held in zip(texts, times, batch.column("held_out").to_pylist(), strict=True) if n]
            for t, n, all_ in rows:
                if n == 1:
                    words.update(t.split())
                elif n:
                    words.update({w: n * k for w, k in Counter(t.split()).items()})
                words[b""] += n  # the empty word stands for the end of a text
                if n < all_:
                    untrained.update(t.split())
            for some in ([r for r in rows if r[1]], [r for r in rows if not r[1]]):
                sums.append(counted([t for t, _, _ in some], [n for _, n, _ in some]))
            if len(sums) > 16:
                sums = [summed(sums)]
        if chunk is None:
            return
        key, n = summed(sums)
        for a in range(0, len(key), 1 << 19):
            k = len(part := key[a : a + (1 << 19)])
            yield pa.RecordBatch.from_arrays([pa.repeat(chunk, k), pa.array(part.astype(np.int64)), pa.nulls(k, pa.binary()), pa.array(n[a : a + k])], schema=found)
        for w in untrained:
            words.setdefault(w, 0)
        word, n = list(words), list(words.values())
        for a in range(0, len(word), 1 << 19):
            k = len(part := word[a : a + (1 << 19)])
            yield pa.RecordBatch.from_arrays([pa.repeat(chunk, k), pa.nulls(k, pa.int64()), pa.array(part, pa.binary()), pa.array(n[a : a + k], pa.int64())], schema=found)

    first = dealt.repartitionById(n_chunks, F.col("chunk")).sortWithinPartitions(F.col("times") == 0)
    counts = settled(first.mapInArrow(count, "chunk int, key long, word binary, n long"))
    key_counts, word_counts = counts.filter("key is not null"), counts.filter("word is not null")
    words = settled(word_counts.groupBy("word").agg(F.sum("n").alias("n")))
    known, total = words.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    built = pa.schema([("key", pa.int64()), ("p", pa.binary()), ("node", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("whole", pa.float64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _whole_groups(batches, ("key", "n"), lambda key: key >> 8 & ((1 << 8 * SPLIT) - 1), BUILD_KEYS):
            p, (node, whole, n0, n1) = tree(key, n, SPLIT)
            up, at = np.unique(parents(node, SPLIT - 1), return_inverse=True)
            n0, n1, whole = (np.bincount(at, x, len(up)) for x in (n0, n1, whole))
            k, m = len(key), len(up)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(key), pa.nulls(m, pa.int64())]), pa.concat_arrays([_packed(p), pa.nulls(m, pa.binary())]),
                    *(pa.concat_arrays([pa.nulls(k, t), pa.array(x, t)]) for x, t in ((up, pa.int64()), (n0, pa.float64()), (n1, pa.float64()), (whole, pa.float64()))),
                ], schema=built,
            )

    in_subtree = F.shiftright("key", 8).bitwiseAND((1 << 8 * SPLIT) - 1)
    whole = key_counts.groupBy("key").agg(F.sum("n").alias("n")).withColumn("subtree", in_subtree).repartition("subtree").sortWithinPartitions("subtree").select("key", "n")
    built_rows = settled(whole.mapInArrow(build, "key long, p binary, node long, n0 double, n1 double, whole double"))

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n0, n1, below = (batch.column(c).to_numpy() for c in ("node", "n0", "n1", "whole"))
            whole, weight = mix(estimate(n0, n1), below)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, n0, n1, whole, weight)], names=["node", "n0", "n1", "whole", "weight"])

    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "whole")]
    second = settled(built_rows.filter("node is not null").groupBy("node").agg(*sums).mapInArrow(mixed, "node long, n0 double, n1 double, whole double, weight double"))
    first_node = F.shiftright("node", 8).bitwiseAND(255) * 256 + F.col("node").bitwiseAND(255)
    upper = top(second.groupBy(first_node.alias("node")).agg(*sums).orderBy("node").toPandas())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, ("node", "n0", "n1", "weight"), lambda node: node >> 8, 1 << 14):
            cut = np.flatnonzero(np.diff(columns[0] >> 8)) + 1
            parts = [along(*x) for x in zip(*(np.split(c, cut) for c in columns), strict=True)]
            suffix, weight, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(suffix), _packed(np.concatenate([weight, own], axis=1))], names=["suffix", "second"])

    paths = second.withColumn("context", F.shiftright("node", 8)).repartition("context").sortWithinPartitions("context").select("node", "n0", "n1", "weight").mapInArrow(spread, "suffix long, second binary")

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            p, x = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<f4").reshape(len(key), -1).astype(float) for c in ("p", "second"))
            p = x[:, :8] * x[:, 8:] + (1 - x[:, :8]) * p
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(score_bits(p, key >> 8 & 255, key & 255, upper))], names=["key", "value"])

    trained = built_rows.filter("key is not null").select("key", "p", F.col("key").bitwiseAND((1 << 24) - 1).alias("suffix"))
    key_values = trained.join(paths, "suffix").select("key", "p", "second").mapInArrow(value, "key long, value double")
    back = key_counts.select("chunk", "key").join(key_values, "key").select("chunk", "key", F.lit(None).cast("binary").alias("word"), "value")
    back = back.unionByName(word_counts.select("chunk", "word").join(words.select("word", F.col("n").cast("double").alias("value")), "word").select("chunk", F.lit(None).cast("long").alias("key"), "word", "value"))
    texts = dealt.withColumn("kind", F.when(F.col("times") == 0, 2).otherwise(1))
    both = back.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)

    bottom = math.log10(total + 1 * (known + 1))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: dict[bytes, float] = {}
        more: dict[int, int] = {}
        find = key_val = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            given = batch.slice(0, int((kind == 0).sum()))  # rows come in order of kind
            if len(given):
                is_key = given.column("key").is_valid().to_numpy(zero_copy_only=False)
                val = given.column("value").to_numpy()
                held.append((given.column("key").drop_null().to_numpy(), val[is_key]))
                seen.update(zip(given.column("word").drop_null().to_pylist(), val[~is_key].tolist(), strict=True))
            rest = batch.slice(len(given))
            if not len(rest):
                continue
            if find is None:
                key, key_val = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.argsort(key)
                find, key_val = Finder(key[order].astype(np.uint64)), key_val[order]
                unknown = {w for w, c in seen.items() if not c}
                seen = {w: math.log10(c + 1) for w, c in seen.items()}
            for part, whole_texts in portions([rest]):
                times = _times(part, more)
                texts = [lower(t) for t in whole_texts]
                got = key_val[find(keys([t + END for t, n in zip(texts, times, strict=True) if n]))]
                run = np.concatenate([[0.0], np.cumsum(got)])
                out, at = [], 0
                for doc, h, t, n in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts, times, strict=True):
                    if n:
                        tokens = [*t.split(), b""]
                        base = math.fsum(map(seen.__getitem__, tokens)) - len(tokens) * bottom
                        s = float(run[at + len(t) + 1] - run[at])
                        at += len(t) + 1
                        out += [(doc, h, len(tokens), len(tokens) - sum(map(unknown.__contains__, tokens)), total, base, s, -s / math.log10(2) / (len(t) + 1))] * n
                for a in range(0, len(out), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + (1 << 16)], strict=True), schema, strict=True)], schema=schema)

    last = both.repartitionById(n_chunks, F.col("chunk")).sortWithinPartitions("kind")
    return last.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _times(batch: pa.RecordBatch, more: dict[int, int]) -> list[int]:
    """How often each row counts: one, and for the first of its hash what `more` has; rows without a text go to `more` and count none."""
    out = []
    for h, n in zip(batch.column("h").to_pylist(), batch.column("times").to_pylist(), strict=True):
        if n:
            more[h] = more.get(h, 0) + n
        out.append(0 if n else 1 + more.pop(h, 0))
    return out


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of x as binary, four bytes a number."""
    return pa.Array.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, "<f4"))]).cast(pa.binary())


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], group, most: int) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups that come in order, about `most` rows at a time, or one group that is larger."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in columns])
        if sum(len(h[0]) for h in held) >= most:
            now = [np.concatenate(x) for x in zip(*held, strict=True)]
            of = group(now[0])
            other = np.flatnonzero(of != of[-1])
            end = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
            if end:
                yield [x[:end] for x in now]
            held = [[x[end:] for x in now]]
    if held and len(held[0][0]) + sum(len(h[0]) for h in held[1:]):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
