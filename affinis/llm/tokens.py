"""Token-ID / binary output: packed sequences in training order, in fixed-stride shards."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import passing, portions, scratch, settled

#: Folder of the vocabulary files; any other path may be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits as 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ does, in less time.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+$|\s+(?!\S)|\s"
#: Of zstd, for tokens on disk and in the shuffle: higher ones take half as much time again and save half a percent.
LEVEL = 6
LENGTH, SHARD = 2048, 1024
#: Documents, and bytes of each, from which a dictionary for the shuffled pieces is made; bytes of the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 64 << 10
_cached: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a .tiktoken file; the id after its last one ends a document. Read once in each worker."""
    if vocabulary not in _cached:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cached[vocabulary] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks))
    return _cached[vocabulary]


def sent(spark: SparkSession, vocabulary: str) -> str:
    """Name under which the workers find the vocabulary file: the driver's is sent to them."""
    name = os.path.basename(vocabulary)
    spark.sparkContext.addFile(vocabulary)
    return name


class Feistel:
    """A keyed permutation of 0 to n - 1: four Feistel rounds on the next even number of bits, walked until the image lies inside."""

    def __init__(self, n: int, key: str, rounds: int = 4):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        digest = hashlib.sha256(key.encode()).digest()
        self.keys = [np.uint64(int.from_bytes(digest[8 * i : 8 * i + 8], "little")) for i in range(rounds)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for k in keys:
            left, right = (right ^ self._round(left, k), left) if back else (right, left ^ self._round(right, k))
        return left << h | right

    def _walk(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys, back)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._once(x[out], keys, back)
        return x.astype(np.int64)

    def slot(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def origin(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, h, part, nth, n_tokens, tokens (little-endian uint16, or uint32 for a larger vocabulary, the end mark included) for each row of docs.

    h is the hash of id and text, by which documents are ordered; part is the partition that made the row, nth how many rows of that hash
    it had before.
    """
    name = sent(ship(docs.sparkSession), vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])

    def work(batches):
        coder, end = encoder(SparkFiles.get(name))
        kind = "<u2" if end < 1 << 16 else "<u4"
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch, texts in portions(batches):
            got = [np.array([*coder.encode_ordinary(t), end], kind) for t in texts]
            nth = []
            for h in batch.column("h").to_pylist():
                nth.append(seen[h])
                seen[h] += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.full(len(got), part, np.int32)), pa.array(nth, pa.int64()), pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], schema=schema)

    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(id_, "text").alias("h"), "text")
    return rows.mapInArrow(work, "doc_id long, h long, part int, nth long, n_tokens long, tokens binary")


def dictionary(rows: DataFrame, count: int) -> bytes:
    """What the pieces that are shuffled have in common, from the beginnings of about SAMPLE of the `count` documents, those whose hashes are smallest; empty where they are too few.

    It only makes the shuffle smaller; the shards don't depend on it.
    """
    highest = min((1 << 63) - 1, -(1 << 63) + ((1 << 64) * SAMPLE) // max(1, count))
    drawn = rows.filter(F.col("h") <= highest).select(F.substring("tokens", 1, SAMPLE_BYTES).alias("t")).limit(2 * SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r.t) for r in drawn]).as_bytes()
    except zstandard.ZstdError:
        return b""


#: Documents of a range of hashes, whose places one task adds up.
RANGE_ROWS = 1 << 20


def places(rows: DataFrame, folder: str, count: int) -> int:
    """Writes to folder, for each part of the `count` rows, the place of its documents in the stream; returns the stream's tokens.

    The stream is in order of h, then id, so it is the same however the table is split. A part has a file of its hashes with the place
    of the first of its rows of each; rows that are alike follow each other, so a hash that a third of all rows bear is one entry of a part.
    Ranges of hashes are added up apart and laid end to end; only a sum for each comes to the driver.
    """
    spark = rows.sparkSession
    alike = rows.groupBy("h", "doc_id", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    ranges = max(1, -(-count // RANGE_ROWS))
    at = F.floor((F.col("h").cast("double") + float(1 << 63)) / (float(1 << 64) / ranges))  # rises with h
    alike = settled(alike.withColumn("range", F.least(F.lit(ranges - 1), at).cast("int")))
    sums = alike.groupBy("range").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("s")).orderBy("range").collect()
    ends = np.cumsum([r.s for r in sums], dtype=np.int64)
    base = spark.createDataFrame([(r.range, int(e) - r.s) for r, e in zip(sums, ends, strict=True)], "range int, base long")
    inside = Window.partitionBy("range").orderBy("h", "doc_id", "n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("at", F.coalesce(F.sum(F.col("n") * F.col("n_tokens")).over(inside), F.lit(0))).join(base, "range").select("part", "h", "doc_id", (F.col("at") + F.col("base")).alias("at"))

    def put(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, held = None, []

        def end_part():
            name = f"{root}/.{part}-{uuid.uuid4().hex}"
            with fs.open_output_stream(name, compression=None) as f, pa.ipc.new_file(f, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            fs.move(name, f"{root}/{part}.arrow")

        for batch in batches:
            of = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and of[a] != part:
                    end_part()
                    held = []
                part = int(of[a])
                held.append(batch.slice(a, b - a).select(["h", "doc_id", "at"]))
        if held:
            end_part()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], names=["done"])

    placed.repartition("part").sortWithinPartitions("part").mapInArrow(put, "done int").count()
    return int(ends[-1]) if len(ends) else 0


def materialise(docs: DataFrame, folder: str, key: str = "order", vocabulary: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Writes shards and a manifest to folder and returns what they hold: slot, shard, position, path, sequence, n_tokens, doc_ids, sha256 for each sequence.

    The tokens of all documents, each with an end mark, form one stream in the order of a hash of id and text, so that equal tables give equal
    shards on any cluster; it is cut into sequences of `length` (the last is filled with end marks; n_tokens leaves those out). Sequence i
    goes to slot Feistel(i). Shard s is a file with the slots s * shard to (s + 1) * shard - 1 at a fixed stride, so slot k is read at
    k % shard * stride of file k // shard, and a reader can go on from any slot. Null and empty texts give an end mark
    alone; a very long text goes through as many sequences as it fills; repeated rows are written as often as they come; other columns are
    left aside; an empty table gives a manifest without shards. A task writes a shard under another name and renames it.
    Tokens are written to the shared folder once, with small files of their places; they are then shuffled once, compressed, to ranges of shards.
    """
    spark = ship(docs.sparkSession)
    _, end = encoder(vocabulary)
    kind = "<u2" if end < 1 << 16 else "<u4"
    with passing(spark) as keep:  # tokens and places are read by the shards' tasks alone
        return _shards(docs, folder, key, vocabulary, length, shard, end, kind, keep)


def _shards(docs: DataFrame, folder: str, key: str, vocabulary: str, length: int, shard: int, end: int, kind: str, keep: list[str]) -> DataFrame:
    spark = docs.sparkSession
    wide = np.dtype(kind).itemsize
    rows = settled(tokenized(docs, vocabulary), level=LEVEL)
    index = scratch(spark)
    count = rows.count()
    total = places(rows.drop("tokens"), index, count)
    common = dictionary(rows, count)
    n = -(-total // length)
    shards = -(-n // shard)
    order = Feistel(n, key)
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json", compression=None) as f:
        f.write(json.dumps({"key": key, "length": length, "shard": shard, "dtype": kind, "stride": length * wide, "end": end, "vocabulary": os.path.basename(vocabulary), "tokens": total, "sequences": n, "shards": shards}).encode())
    piece = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("at", pa.int32()), ("sequence", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.binary())])

    def cut(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(index)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(common) if common else None)
        now, place = None, {}
        for batch in batches:
            out: list[tuple[int, int, int | None, bytes]] = []
            for doc, h, part, nth, tokens in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "part", "nth", "tokens")), strict=True):
                if part != now:
                    with fs.open_input_stream(f"{base}/{part}.arrow") as f:
                        found = pa.ipc.open_file(io.BytesIO(f.read())).read_all().to_pydict()
                    now, place = part, dict(zip(zip(found["h"], found["doc_id"], strict=True), found["at"], strict=True))
                size, k = len(tokens) // wide, 0
                offset = place[h, doc] + nth * size
                while k < size:
                    sequence, at = divmod(offset + k, length)
                    take = min(length - at, size - k)
                    out.append((sequence, at, doc, pack.compress(tokens[k * wide : (k + take) * wide])))
                    k += take
            if out:
                sequence, at, doc, tokens = zip(*out, strict=True)
                slot = order.slot(np.array(sequence, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(slot // shard), pa.array(slot), pa.array(at, pa.int32()), pa.array(sequence, pa.int64()), pa.array(doc, pa.int64()), pa.array(tokens, pa.binary())], schema=piece)

    pieces = rows.select("doc_id", "h", "part", "nth", "tokens").mapInArrow(cut, "shard long, slot long, at int, sequence long, doc_id long, tokens binary")
    report = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("position", pa.int32()), ("path", pa.string()), ("sequence", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sha256", pa.string())])

    def put(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        state: dict = {"shard": None}
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(common) if common else None)
        done: list[tuple] = []

        def end_sequence():
            if state.get("slot") is not None:
                body = b"".join(state["parts"])
                size = len(body) // wide
                body += np.full(length - size, end, kind).tobytes()
                state["file"].write(body)
                done.append((state["slot"], state["shard"], state["slot"] % shard, f"{folder}/{state['shard']:08d}.bin", state["sequence"], size, list(dict.fromkeys(state["docs"])), hashlib.sha256(body).hexdigest()))
            state["slot"] = None

        def end_shard():
            end_sequence()
            if state["shard"] is not None:
                state["file"].close()
                fs.move(state["open"], f"{base}/{state['shard']:08d}.bin")

        for batch in batches:
            for number, slot, sequence, doc, tokens in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "sequence", "doc_id", "tokens")), strict=True):
                if number != state["shard"]:
                    end_shard()
                    state |= {"shard": number, "slot": None, "open": f"{base}/.{number:08d}-{os.getpid()}-{uuid.uuid4().hex}"}
                    state["file"] = fs.open_output_stream(state["open"])
                if slot != state["slot"]:
                    end_sequence()
                    state |= {"slot": slot, "sequence": sequence, "parts": [], "docs": []}
                state["parts"].append(unpack.decompress(tokens))
                state["docs"].append(doc)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), report, strict=True)], schema=report)
                done.clear()
        end_shard()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), report, strict=True)], schema=report)

    # Whole shards go to a task: range partitions of slots, which end where shards do.
    parts = max(1, min(shards, 100_000))
    dealt = pieces.repartitionById(parts, F.floor(F.col("shard") * parts / F.lit(max(1, shards))).cast("int")).sortWithinPartitions("shard", "slot", "at")
    keep.append(scratch(spark))
    return settled(dealt.mapInArrow(put, "slot long, shard long, position int, path string, sequence long, n_tokens long, doc_ids array<long>, sha256 string"), path=keep[0])


def read_slots(folder: str, first: int, count: int) -> np.ndarray:
    """(count, length) token ids of the slots from first on, as the manifest lays them out: seeks to the place in each shard, reads on."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        m = json.loads(f.read())
    if first < 0 or first + count > m["sequences"]:
        raise ValueError(f"the folder has the slots 0 to {m['sequences'] - 1}")
    out = []
    while count > 0:
        number, at = divmod(first, m["shard"])
        take = min(count, m["shard"] - at)
        with fs.open_input_file(f"{base}/{number:08d}.bin") as f:
            f.seek(at * m["stride"])
            out.append(np.frombuffer(f.read(take * m["stride"]), m["dtype"]).reshape(-1, m["length"]))
        first, count = first + take, count - take
    return np.concatenate(out) if out else np.zeros((0, m["length"]), m["dtype"])


def training_order(docs: DataFrame) -> DataFrame:
    """The report of materialise() into a new folder of the shared ones."""
    return materialise(docs, scratch(docs.sparkSession))
