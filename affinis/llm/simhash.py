"""Near-duplicates: SimHash with bit-sliced comparison inside blocks; then connected components.

Fingerprints within RADIUS bits are found by exact blocks. A Jaccard similarity of 0.8 moves a tenth of the bits and more, where no division
of 64 bits gives useful blocks; there the blocks come from MinHash bands, longer fingerprints are compared bit-sliced inside them, and
what that leaves is compared by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, passing, portions, scratch, settled

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Blocks of more fingerprints are divided again, by 6 more bits at least.
BLOCK = 2048
#: Words of a shingle where texts are linked by the Jaccard similarity of their shingles; the least that links in the pipeline.
WORDS, SIMILAR = 5, 0.8
#: Blocks hold what agrees in ROWS of BANDS * ROWS minima: at a similarity of 0.8 a pair has no block in common with probability (1 - 0.8^4)^30, 1e-7.
BANDS, ROWS = 30, 4
#: Those in a block are compared by sets where SimHashes of BITS bits differ by FAR at most: a pair at 0.8 differs in 39 on average (48 if it has but five shingles), with a deviation of 6.
BITS, FAR = 256, 79
#: What a task holds of a group at once: bytes of sketches or of sets.
SKETCH_BYTES, SET_BYTES = 32 << 10, 16 << 20
_MIX = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.random.default_rng(SEED + 1).integers(0, 2**63, (2, BITS // 64), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, of all words where there are fewer; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: len(words) - k].tolist(), end[k:].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k)


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the shingles' XXH64; 0 for a text without words."""
    h = shingles(text, SHINGLE)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 60_000):
        bits = np.unpackbits(h[i : i + 60_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def planes_of(fps: list[int], bits: int) -> list[tuple[int, int]]:
    """(bit, vertical bit vector of it) of the bits in which fps differ."""
    raw = np.frombuffer(b"".join(f.to_bytes(bits // 8, "little") for f in fps), np.uint8).reshape(len(fps), -1)
    rows = np.unpackbits(raw, axis=1, bitorder="little").T
    some = np.flatnonzero(rows.any(axis=1) & ~rows.all(axis=1))
    return [(int(b), int.from_bytes(np.packbits(rows[b], bitorder="little").tobytes(), "little")) for b in some]


def near(n: int, of: int, planes: list[tuple[int, int]], radius: int, own: int = 0, fixed: int = 0) -> int:
    """Bit vector of the n positions whose fingerprint differs from `of` in at most radius bits.

    planes: (bit, vertical bit vector of it); fixed: bits in which `of` differs from all, for which there is no plane. Carry-save counters
    hold each position's distance; one that passes the radius stays marked, and the block is given up when only `own` is left.
    """
    everyone = (1 << n) - 1
    counters = [everyone if fixed >> i & 1 else 0 for i in range(radius.bit_length() + 1)]
    gone = 0 if fixed <= radius else everyone
    for k, (bit, plane) in enumerate(planes):
        carry = plane ^ everyone if of >> bit & 1 else plane
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        gone |= carry
        if k & 3 == 3:
            gone |= _above(counters, radius, everyone)
            if gone | own == everyone:
                return own
    return everyone & ~(gone | _above(counters, radius, everyone))


def _above(counters: list[int], radius: int, everyone: int) -> int:
    """Positions whose counter is greater than radius."""
    more, equal = 0, everyone
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            more |= equal & counters[i]
            equal &= ~counters[i]
    return more


def reached(names: list[int], near_) -> list[tuple[int, int]]:
    """(name, representative) of those reached breadth first; near_(at, left) gives the bit vector of the positions that are linked to at, of those in left at least."""
    left, out = (1 << len(names)) - 1, []
    while left:
        root = (left & -left).bit_length() - 1
        left &= left - 1
        open_ = [root]
        while open_ and left:
            found = near_(open_.pop(), left) & left
            left &= ~found
            while found:
                i = (found & -found).bit_length() - 1
                found &= found - 1
                open_.append(i)
                out.append((names[i], names[root]))
    return out


def groups_in(fps: list[int]) -> list[tuple[int, int]]:
    """(fingerprint, representative) of those linked inside one block, by breadth-first search over bit-sliced queries."""
    if len(fps) == 2:
        return [(fps[1], fps[0])] if (fps[0] ^ fps[1]).bit_count() <= RADIUS else []
    planes = planes_of(fps, 64)
    return reached(fps, lambda at, left: near(len(fps), fps[at], planes, RADIUS, 1 << at))


def _pieces(bits: list[int]) -> list[int]:
    """Masks of five pieces of the bits."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), 5)]


def _masks() -> list[tuple[int, list[int]]]:
    """Two fingerprints within 2 bits agree in 3 of 5 pieces at least. So ten masks find every pair, and of each, the ten that divide its other bits again do so too."""
    out = []
    for keep in combinations(_pieces(list(range(64))), 3):
        mask = sum(keep)
        out.append((mask, [mask | sum(more) for more in combinations(_pieces([b for b in range(64) if not mask >> b & 1]), 3)]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """(u, v): a forest of the links at RADIUS or less between the distinct fingerprints in column fp.

    Blocks hold what agrees in 38 bits or more; those with over BLOCK members are divided by more bits, after which at
    most 12 bits are free, so none can exceed 4096. All fingerprints stay in the search.
    """
    masks = _masks()
    array = lambda found: F.array(*[F.lit(_signed(m)) for m in found])
    keyed = lambda df, at, found: df.select("fp", F.explode(F.transform(found, lambda m, i: F.struct((at + i).cast("int").alias("t"), F.col("fp").bitwiseAND(m).alias("key")))).alias("k")).select("k.t", "k.key", "fp")
    first = keyed(fps, F.lit(0), array([m for m, _ in masks]))
    size = first.groupBy("t", "key").count().filter("count > 1")
    first = settled(first.join(size, ["t", "key"]))
    more = F.element_at(F.array(*[array(m) for _, m in masks]), F.col("t") + 1)
    again = keyed(first.filter(F.col("count") > BLOCK), 100 * (F.col("t") + 1), more)
    blocks = first.filter(F.col("count") <= BLOCK).select("t", "key", "fp").unionByName(again)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(fp: np.ndarray) -> list[tuple[int, int]]:
            return groups_in(np.unique(fp.view(np.uint64)).tolist()) if len(fp) > 1 else []

        last = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if last is not None:
                now = [np.concatenate(x) for x in zip(last, now, strict=True)]
            t, key, fp = now
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            edges = [0, *cut.tolist()]
            out = [e for a, b in zip(edges[:-1], edges[1:], strict=True) for e in emit(fp[a:b])]
            last = [x[edges[-1] :] for x in now]
            if out:
                yield _batch(out, schema)
        if last is not None and (out := emit(last[2])):
            yield _batch(out, schema)

    return blocks.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(work, "u long, v long")


def _batch(pairs: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    a = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), by alternating large-star and small-star rounds.

    Each round is written to the shared folder; a round that changes nothing ends it. Only a count comes to the driver.
    """
    spark = edges.sparkSession
    now = scratch(spark)
    edges = settled(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path=now)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        then = scratch(spark)
        after = settled(small, path=then)
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        discard(spark, now)
        edges, now = after, then
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def set_hash(ordered: np.ndarray) -> int:
    """Name of a set of shingles; 0 for none."""
    return int(np.uint64(xxhash.xxh64_intdigest(ordered.tobytes(), SEED)).view(np.int64)) if len(ordered) else 0


def bands(ordered: np.ndarray) -> list[int]:
    """A key of each band, made of its number and ROWS minima of the shingles under mixings of their own."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(ordered), 256):
        least = np.minimum(least, ((ordered[i : i + 256, None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def sketch(ordered: np.ndarray) -> bytes:
    """SimHash of BITS bits of a set of shingles."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(ordered), 4096):
        lanes = (ordered[i : i + 4096, None] ^ _LANES[0]) * _LANES[1]
        lanes ^= lanes >> np.uint64(32)
        lanes *= _LANES[0]
        lanes ^= lanes >> np.uint64(29)
        ones += np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(ordered), bitorder="little").tobytes()


class Sketches:
    """Sketches of a group as bit planes: which differ from another in at most FAR bits."""

    def __init__(self, values: list[bytes]):
        self.fps = [int.from_bytes(v, "little") for v in values]
        self.planes = planes_of(self.fps, BITS) if len(values) > 8 else None
        self.constant = sum(1 << b for b in set(range(BITS)) - {b for b, _ in self.planes}) if self.planes is not None else 0

    def near(self, value: bytes, left: int) -> int:
        of = int.from_bytes(value, "little")
        if self.planes is None:  # of a few, planes cost more than they save
            return sum(1 << i for i, f in enumerate(self.fps) if (f ^ of).bit_count() <= FAR)
        return near(len(self.fps), of, self.planes, FAR, ((1 << len(self.fps)) - 1) & ~left, ((of ^ self.fps[0]) & self.constant).bit_count())


class Sets:
    """Sets of shingles of a group: which have a Jaccard similarity of `least` or more with another."""

    def __init__(self, values: list[bytes], least: float):
        self.least, self.size = least, np.array([len(s) // 8 for s in values])
        self.known, self.code = np.unique(np.frombuffer(b"".join(values), np.uint64), return_inverse=True)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.left = (-1, None, None, None)

    def near(self, value: bytes, left: int) -> int:
        if self.left[0] != left:  # the codes of those that are left, kept while none is taken out
            at = np.flatnonzero(np.unpackbits(np.frombuffer(left.to_bytes((len(self.size) + 7) // 8, "little"), np.uint8), bitorder="little"))
            size = self.size[at]
            begin = np.cumsum(size) - size
            self.left = (left, at, begin, self.code[np.repeat(self.start[at] - begin, size) + np.arange(size.sum())])
        _, at, begin, code = self.left
        own = np.zeros(len(self.known), np.int64)
        mine = np.frombuffer(value, np.uint64)
        k = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        own[k[self.known[k] == mine]] = 1
        both = np.add.reduceat(own[code], begin)
        linked = np.zeros(len(self.size), bool)
        linked[at[both >= self.least * (self.size[at] + len(mine) - both) - 1e-9]] = True
        return int.from_bytes(np.packbits(linked, bitorder="little").tobytes(), "little")


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _in_groups(rows: DataFrame, keys: list[str], order: list[str], end_group, take) -> DataFrame:
    """(u, v): take(group, row) of each row of a group, in order, and end_group(group) after them give edges; group is a dict of the task's own."""
    at = {c: i for i, c in enumerate(rows.columns)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, {}, []

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], schema=_EDGE)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key := [row[at[k]] for k in keys]) != now:
                    out += end_group(group) if group else []
                    now, group = key, {}
                out += take(group, {c: row[i] for c, i in at.items()}) or []
            if out:
                yield batch_of(out)
                out = []
        if group and (out := end_group(group)):
            yield batch_of(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, "u long, v long")


def linked(rows: DataFrame, keys: list[str], make, most: int) -> DataFrame:
    """(u, v): a forest of the links inside the groups of rows (keys, fp, value); make(values) has near(value, left).

    A group of more than `most` bytes is dealt into parts, each of which is searched with the group's least row, its pivot, so that a part is
    held at a time. Most of a group is linked to its pivot; what isn't then meets all parts that hold another component: no link is
    lost, and no task holds more than a part.
    """
    size = rows.groupBy(*keys).agg(F.sum(F.octet_length("value") + 16).alias("bytes"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    size = settled(size.select(*keys, F.ceil(F.col("bytes") / most).cast("int").alias("parts")))
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col(n)).cast("int")
    placed = rows.join(size, keys).withColumn("part", part(1, "parts"))
    big = placed.filter("parts > 1")
    some_big = not size.filter("parts > 1").isEmpty()
    first = placed.select(*keys, "part", "fp", "value")
    if some_big:
        pivot = big.groupBy(*keys).agg(F.min(F.struct("fp", "value")).alias("p"), F.first("parts").alias("parts"))
        first = first.unionByName(pivot.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "p.fp", "p.value"))

    def hold(group: dict, row: dict):
        group.setdefault("names", []).append(row["fp"])
        group.setdefault("values", []).append(row["value"])

    def search(group: dict):
        names, values = group["names"], group["values"]
        if len(names) < 2:
            return []
        like = make(values)
        return reached(names, lambda at, left: like.near(values[at], left))

    edges = _in_groups(first, [*keys, "part"], ["fp"], search, hold)
    if not some_big:
        return edges
    edges = settled(edges)
    found = components(edges)
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    named = settled(big.join(found, F.col("fp") == F.col("node"), "left").select(*keys, "parts", "part", "fp", "value", F.coalesce("root", "fp").alias("root")))
    sizes = named.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 16).alias("bytes"))
    main = sizes.groupBy(*keys).agg(F.max(F.struct("n", "root")).alias("m"), F.sum("bytes").alias("all"), F.max_by("bytes", F.struct("n", "root")).alias("own"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    main = main.select(*keys, F.col("m.root").alias("main"), F.ceil((F.col("all") - F.col("own")) / most).cast("int").alias("rests"))
    opened = named.join(main, keys)
    rest = opened.filter("root <> main").withColumn("rest", part(2, "rests"))
    held = opened.select(*keys, "part", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("rest"), F.lit(0).alias("kind"), "fp", "root", "value")
    asked = rest.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rest", F.lit(1).alias("kind"), "fp", "root", "value")

    def ask(group: dict, row: dict):
        if not row["kind"]:
            group.setdefault("roots", []).append(row["root"])
            return hold(group, row)
        if "values" not in group:
            return []  # no row fell into this part
        if "like" not in group:
            group["like"] = make(group["values"])
            of: dict[int, int] = {}
            for i, r in enumerate(group["roots"]):
                of[r] = of.get(r, 0) | 1 << i
            group["of"] = of
        other = ((1 << len(group["names"])) - 1) & ~group["of"].get(row["root"], 0)
        hit = group["like"].near(row["value"], other) & other if other else 0
        return [(row["fp"], r) for r, bits in group["of"].items() if hit & bits]

    return edges.unionByName(_in_groups(held.unionByName(asked), [*keys, "part", "rest"], ["kind"], lambda group: [], ask))


def similar_links(docs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(u, v): links at Jaccard similarity `least` or more between the sets of shingles in classes: fp, bands, sketch, text_hash of one text.

    Blocks with the same members are searched once, by bit-sliced sketches, which go only with members of blocks of two or more. What these
    link is compared by the sets, which are made anew for it, and moved once.
    """
    keyed = classes.filter("fp <> 0").select("fp", F.explode("bands").alias("key"))
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x")).filter("n > 1")
    once = size.groupBy("n", "x").agg(F.min("key").alias("key")).select("key")
    # Neither side of these joins is bounded, so they merge at every size.
    members = keyed.join(once.hint("merge"), "key").join(classes.select("fp", F.col("sketch").alias("value")), "fp").select("key", "fp", "value")
    alike = components(linked(settled(members), ["key"], Sketches, SKETCH_BYTES))
    group = settled(alike.unionByName(alike.select(F.col("root").alias("node"), "root").distinct()).join(classes.select(F.col("fp").alias("node"), "text_hash"), "node"))
    schema = pa.schema([("fp", pa.int64()), ("value", pa.binary())])

    def sets(batches):
        for _, texts in portions(batches):
            made = [np.unique(shingles(t, WORDS)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], schema=schema)

    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(group.select("text_hash").hint("merge"), "text_hash", "left_semi")
    made = settled(texts.dropDuplicates(["text_hash"]).select("text").mapInArrow(sets, "fp long, value binary"))
    return linked(group.select("root", F.col("node").alias("fp")).join(made, "fp").select("root", "fp", "value"), ["root"], lambda values: Sets(values, least), SET_BYTES)


def _named(rows: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with root, which names the component of fp over the edges, and component_id, the smallest doc_id of all its rows."""
    joined = components(edges)
    reach = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    named = classes.join(reach, classes.fp == reach.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _hex(c: str):
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def _fingerprints(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def work(batches):
        for batch, texts in portions(batches):
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], schema=schema)

    return settled(_hashed(docs).mapInArrow(work, "doc_id long, text_hash long, fp long"))


def similar_groups(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """doc_id, text_hash, set_name, root, component_id for each row of docs, linked by the Jaccard similarity of their sets of WORDS-word shingles.

    Texts of fewer words are one shingle. Null and wordless texts are linked to each other. Ids are treated as by near_duplicates;
    root names the component even where all its ids are null. Whole texts are read, however long, a few at a time.
    """
    ship(docs.sparkSession)
    if not SIMILAR <= similarity <= 1:
        raise ValueError("the blocks are made for similarities of 0.8 and more")
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def work(batches):
        for part, texts in portions(batches):
            made = [np.unique(shingles(t, WORDS)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([set_hash(s) for s in made], pa.int64()), pa.array([bands(s) for s in made], pa.list_(pa.int64())), pa.array([sketch(s) for s in made], pa.binary())], schema=schema)

    rows = settled(_hashed(docs).mapInArrow(work, "doc_id long, text_hash long, fp long, bands array<bigint>, sketch binary"))
    classes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("text_hash", "bands", "sketch")).alias("s")).select("fp", "first", "s.text_hash", "s.bands", "s.sketch"))
    found = _named(rows.select("doc_id", "text_hash", "fp"), classes.select("fp", "first"), similar_links(docs, classes, similarity))
    return found.select("doc_id", "text_hash", _hex("fp").alias("set_name"), "root", "component_id")


def near_duplicates(docs: DataFrame, similarity: float | None = SIMILAR) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id for each row of docs.

    component_id is the smallest doc_id among all rows that can be reached by steps of Jaccard similarity `similarity` or more
    (similar_groups), or, with None, of fingerprints that differ in at most RADIUS bits. Null
    and wordless texts have fingerprint zero. A null doc_id never names a component, unless all its rows' ids are null;
    repeated rows come back repeated. Other columns are left aside. An empty table gives no rows. Whole texts are read, however
    long, a few at a time.
    """
    ship(docs.sparkSession)
    rows = _fingerprints(docs)
    if similarity is None:
        classes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
        found = _named(rows, classes, links(classes.select("fp")))
    else:
        of = rows.groupBy("text_hash").agg(F.min("fp").alias("fp"))
        found = similar_groups(docs, similarity).join(of, "text_hash")
    return found.select("doc_id", "text_hash", _hex("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """The rows of docs without all but one of each component of similar_groups: that of its smallest doc_id, once.

    Of rows that share that id, those of the smallest text hash; of equal rows, one. Null and wordless texts are alike, so one of them stays; whole texts are read,
    however long; an empty table stays empty; columns of any names go along.
    """
    spark = ship(docs.sparkSession)
    # What is kept is one small row for each component; what led there goes at once, so the result reads nothing else, whenever it is read.
    with passing(spark) as keep:
        found = similar_groups(docs, similarity).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        # The rows that bear a component's name are few, whatever its size, unless ids repeat; counting comes first.
        counted = found.groupBy("root", "doc_id", "text_hash").count()
        keep.append(scratch(spark))
        one = settled(counted.groupBy("root").agg(F.min(F.struct("text_hash", "doc_id", "count")).alias("s")).select("s.doc_id", "s.text_hash", "s.count"), path=keep[0])
    # Every text goes with its hash, and null texts with one of their own, so a row of docs has one (id, hash).
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    match = lambda ids: rows.join(ids.hint("merge"), rows["doc_id"].eqNullSafe(ids["doc_id"]) & (rows["text_hash"] == ids["text_hash"]), "left_semi")
    out = match(one.filter("count = 1").select("doc_id", "text_hash"))
    many = one.filter("count > 1").select("doc_id", "text_hash")
    if not many.isEmpty():
        out = out.unionByName(match(many).dropDuplicates(["doc_id", "text_hash"]))
    return out.select("row.*")
