"""Benchmark decontamination: q-gram lemma over overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import portions, row_and_text, scratch

Q, EDITS = 8, 0.08
#: Benchmark text whose index a worker holds at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 4 << 20
#: Text that waits in a worker for all blocks, if there are several.
HELD_BYTES = 32 << 20
#: Places of shared grams that are looked at in one go.
POSTS = 2 << 20
_GAP = b"\0" * Q
_SLOTS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    """Lower-case A-Z, words joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().replace(b"\0", b" ").split())


def grams(data: bytes) -> np.ndarray:
    """The 8-byte grams of data as integers."""
    a = np.frombuffer(data, np.uint8)
    n = len(a) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.empty(n, np.uint64)
    for shift in range(Q):  # eight views of the bytes, each read as integers
        part = np.frombuffer(data, "<u8", (len(a) - shift) // Q, shift)
        g[shift::Q] = part[: len(g[shift::Q])]
    return g


class Items:
    """The grams of benchmark items with their places, and each item's budget and threshold.

    An occurrence with at most e edits of an item of m bytes keeps m + 1 - q (e + 1) of its grams, all within e diagonals of
    each other. e is EDITS of the length, or less where that count would fall below 1; items shorter than q match exactly.
    """

    def __init__(self, items: list[tuple[int | None, bytes]]):
        items = [x for x in items if x[1]]
        self.ids = [x[0] for x in items]
        self.texts = [x[1] for x in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.longest = int(size.max(initial=0))
        self.edits = np.maximum(0, np.minimum((EDITS * size).astype(np.int64), (size - Q) // Q))
        self.least = size + 1 - Q * (self.edits + 1)
        self.step = 2 * self.edits + 1
        #: What the least demanding item of a gram or more needs; a text that shares fewer grams with all items together holds none of these.
        self.needed = int(self.least[self.least > 0].min()) if (self.least > 0).any() else 1
        all_grams = [grams(t) for t in self.texts]
        lengths = np.array([len(g) for g in all_grams], np.int64)
        where = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        joined = np.concatenate(all_grams or [np.zeros(0, np.uint64)])
        order = np.argsort(joined, kind="stable")
        self.grams, self.first, self.count = np.unique(joined[order], return_index=True, return_counts=True)
        self.item, self.place = where[order], place[order]
        self.table = np.zeros(1 << _SLOTS, bool)
        self.table[(self.grams * _ODD) >> np.uint64(64 - _SLOTS)] = True
        #: Of items shorter than a gram: for each length their bytes as sorted integers, with the items.
        self.short = {}
        for n in range(1, Q):
            of = np.flatnonzero(size == n)
            if len(of):
                value = np.array([int.from_bytes(self.texts[i], "big") for i in of], np.uint64)
                by = np.argsort(value, kind="stable")
                self.short[n] = value[by], of[by]

    def hits(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, gram, text) of the places in data that have a gram of an item, in texts with as many as any item needs. starts: of the texts in data."""
        g = grams(data)
        at = np.flatnonzero(self.table[(g * _ODD) >> np.uint64(64 - _SLOTS)])
        if not len(at) or not len(self.grams):
            return (np.zeros(0, np.int64),) * 3
        g = g[at]
        k = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        same = self.grams[k] == g
        at, k = at[same], k[same]
        text = np.searchsorted(starts, at, side="right") - 1
        shared = np.bincount(text, weights=self.count[k], minlength=len(starts))
        some = shared[text] >= self.needed
        return at[some], k[some], text[some]

    def bands(self, data: bytes, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, band) that hold the item's threshold of shared grams. starts: of the texts in data.

        Band b of an item has the diagonals b * step to (b + 2) * step, so that any 2 e + 1 neighbours lie in one of them. Texts are
        taken in groups, and a text's grams in slices, that share at most POSTS grams with the items (a gram in more of them is a slice); only
        pairs of text and item that occur are counted.
        """
        at, k, text = self.hits(data, starts)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]]) if len(text) else [0]
        run = np.concatenate([[0], np.cumsum(self.count[k])])
        first = 0
        while first < len(edges) - 1:
            last = max(first + 1, int(np.searchsorted(run[edges], run[edges[first]] + POSTS, side="right")) - 1)
            rows = slice(int(edges[first]), int(edges[last]))
            yield from self._bands_of(at[rows], k[rows], text[rows])
            first = last

    def _posts(self, at: np.ndarray, k: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text * items + item, item, diagonal) of the shared grams, in slices."""
        times = self.count[k]
        run = np.concatenate([[0], np.cumsum(times)])
        a = 0
        while a < len(k):
            b = max(a + 1, int(np.searchsorted(run, run[a] + POSTS, side="right")) - 1)
            n = times[a:b]
            post = np.repeat(self.first[k[a:b]] - (run[a:b] - run[a]), n) + np.arange(run[b] - run[a])
            item = self.item[post].astype(np.int64)
            yield np.repeat(text[a:b], n) * len(self.texts) + item, item, np.repeat(at[a:b], n) - self.place[post]
            a = b

    def _bands_of(self, at: np.ndarray, k: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
        pairs = _summed(np.unique(p, return_counts=True) for p, _, _ in self._posts(at, k, text))
        # A band can't hold more than its text and item share.
        pair = pairs[0][pairs[1] >= self.least[pairs[0] % len(self.texts)]]
        if not len(pair):
            return []
        found = []
        for p, item, diagonal in self._posts(at, k, text):
            number = np.minimum(np.searchsorted(pair, p), len(pair) - 1)
            some = pair[number] == p
            number, item = number[some], item[some]
            band = (diagonal[some] + len(_GAP) + self.longest) // self.step[item]
            key = number << 32
            found.append(np.unique(np.concatenate([key + band, key + np.maximum(band - 1, 0)]), return_counts=True))
        key, n = _summed(found)
        of = pair[key >> 32]
        good = n >= self.least[of % len(self.texts)]
        return [(int(p) // len(self.texts), int(p) % len(self.texts), int(x)) for p, x in zip(of[good], key[good] & 0xFFFFFFFF, strict=True)]

    def verify(self, data: bytes, start: int, end: int, item: int, band: int) -> tuple[int, int, int] | None:
        """(edits, begin, end) of the best alignment of the item on the band's diagonals, within the text; None beyond the budget."""
        e, step, pattern = int(self.edits[item]), int(self.step[item]), self.texts[item]
        shift = len(_GAP) + self.longest
        low = band * step - shift - e
        width = 2 * step + 2 * e + 1
        window = np.zeros(width + len(pattern), np.int64) - 1
        a, b = max(low, start), min(low + len(window), end)
        if a >= b:
            return None
        window[a - low : b - low] = np.frombuffer(data, np.uint8, b - a, a)
        # Costs stand above 20 bits that hold the diagonal at which the alignment began, so minima carry it along.
        one, column = 1 << 20, np.arange(width, dtype=np.int64)
        cost = column.copy()
        for i, c in enumerate(pattern):
            cost = cost + one * (window[i : i + width] != c)
            # cost holds the diagonal moves; a deleted pattern byte comes from the next diagonal of the row before.
            np.minimum(cost[:-1], row[1:] + one, out=cost[:-1]) if i else None
            cost = np.minimum.accumulate(cost - one * column) + one * column
            row = cost
        best = int(np.argmin(cost >> 20))
        if (found := int(cost[best] >> 20)) > e:
            return None
        return found, low + int(cost[best] & (one - 1)), min(end, low + best + len(pattern))

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: (item, edits, begin, end) of the items it holds, the best alignment of each."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        starts = np.cumsum([0, *(len(t) + len(_GAP) for t in texts)])[:-1]
        data = _GAP.join(texts) + _GAP
        for text, item, band in self.bands(data, starts) if texts else ():
            if out[text].get(item, (1,))[0] == 0:
                continue  # no other occurrence can be better
            a = int(starts[text])
            got = self.verify(data, a, a + len(texts[text]), item, band)
            if got and (item not in out[text] or got < out[text][item]):
                out[text][item] = got
        for n, (value, item) in self.short.items():
            a = np.frombuffer(data, np.uint8).astype(np.uint64)
            here = np.zeros(max(0, len(a) - n + 1), np.uint64)
            for i in range(n):
                here = here << np.uint64(8) | a[i : len(a) - n + 1 + i]
            low, high = np.searchsorted(value, here, "left"), np.searchsorted(value, here, "right")
            for at in np.flatnonzero(high > low).tolist():
                k = int(np.searchsorted(starts, at, side="right")) - 1
                for i in item[low[at] : high[at]].tolist():
                    out[k].setdefault(i, (0, at, at + n))
        return [[(i, d, a - int(s), b - int(s)) for i, (d, a, b) in sorted(found.items())] for found, s in zip(out, starts, strict=True)]


def _summed(found) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the sums of their numbers, of several (keys, numbers)."""
    found = list(found)
    if len(found) == 1:
        return found[0]
    key, inverse = np.unique(np.concatenate([k for k, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([n for _, n in found] or [np.zeros(0)]), len(key)).astype(np.int64)


def _blocks(benchmark: DataFrame, folder: str) -> int:
    """Writes the benchmark to folder in blocks of about BLOCK_BYTES, a file each; returns their number. The items don't come to the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").dropDuplicates(["item_id", "text"])
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BLOCK_BYTES))
    schema = pa.schema([("item_id", pa.int64()), ("text", pa.binary())])

    def put(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        block, items = None, []
        for batch in batches:
            for b, i, t in zip(*(batch.column(c).to_pylist() for c in ("block", "item_id", "text")), strict=True):
                block = b
                items.append((i, normal(t)))
        if block is not None:
            items.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            name = f"{base}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(name, compression=None) as f, pa.ipc.new_file(f, schema) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*items, strict=True), schema, strict=True)], schema=schema))
            fs.move(name, f"{base}/{block}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32())], names=["block"])

    placed = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).repartitionById(n, F.col("block"))
    return 0 if not total else placed.mapInArrow(put, "block int").agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns of docs, or of keep), hits (array of item_id, edits, begin, end) for each row of docs.

    begin and end are byte places in the normalised text. Null and empty texts have no hits, nor has any text of an empty
    benchmark; a null or empty item matches nothing, and equal rows of the benchmark count once; repeated rows are searched alike; the columns of
    docs are kept in `row`, so no name clashes. Texts are searched whole, in groups of about 2 MB that share the array work; a longer one is a
    group by itself. The benchmark lies in the shared folder in blocks, of which a worker holds one; if there are several, it gathers
    HELD_BYTES of text before it goes through them.
    """
    spark = ship(docs.sparkSession)
    folder = scratch(spark)
    n = _blocks(benchmark, folder)
    hit = pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])

    def work(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)

        def block(b: int) -> Items:
            if fs.get_file_info(f"{base}/{b}.arrow").type == pyarrow.fs.FileType.NotFound:
                return Items([])  # no item's hash fell into it
            with fs.open_input_stream(f"{base}/{b}.arrow") as f:
                found = pa.ipc.open_file(io.BytesIO(f.read())).read_all()
            return Items(list(zip(found["item_id"].to_pylist(), found["text"].to_pylist(), strict=True)))

        def searched(held):
            hits = [[[] for _ in texts] for _, texts in held]
            for b in range(n):
                items = only or block(b)
                for (_, texts), some in zip(held, hits, strict=True):
                    for one, more in zip(some, items.find(texts), strict=True):
                        one += [{"item_id": items.ids[i], "edits": d, "begin": a, "end": e} for i, d, a, e in more]
            for (rows, _), some in zip(held, hits, strict=True):
                yield pa.RecordBatch.from_arrays([rows, pa.array(some, pa.list_(hit))], names=["row", "hits"])

        only = block(0) if n == 1 else None
        held, size = [], 0
        for batch, texts in portions(batches):
            texts = [normal(t) for t in texts]
            held.append((batch.column("row"), texts))
            size += sum(map(len, texts))
            if n < 2 or size >= HELD_BYTES:
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)

    rows = row_and_text(docs, keep)
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, hits array<struct<item_id:long,edits:int,begin:long,end:long>>")
