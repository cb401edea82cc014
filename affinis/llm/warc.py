"""WARC: one gzip member per record; a sequential reader with incremental decompression, framing and digest checks."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import scratch, settled

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields for page ids, which readers of other archives pass over.
PAGE, REFERS = "X-Page-ID", "X-Page-Refers-To"
#: Equal payloads shorter than this are stored each time.
LEAST_SHARED = 1000
#: An archive is closed when it has so many bytes, so that a lost task costs little.
ARCHIVE_BYTES = 16 << 20
#: Longest head of a record; bytes that decompression gives at a time.
LONGEST_HEAD, PIECE = 1 << 20, 1 << 20


class WarcError(ValueError):
    """A record that is cut short, wrongly framed, or whose digest does not match."""


def name_of(page_id: int | None, digest: str) -> str:
    """The record id of the one response that revisits of a payload name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, named: bool = False) -> bytes:
    """A gzip member with one response, or with a revisit that leaves the payload out.

    Record ids are unique, however often a page id comes: a random one for each record, but for the one response that others refer to, whose id they can tell; named says that there is
    one such response, of a revisit as of the response itself. Page ids are in fields of their own.
    """
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name_of(page_id, digest) if named and refers_to is None else f'<urn:uuid:{uuid.uuid4()}>'}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Profile: {REVISIT_PROFILE}", *([f"WARC-Refers-To: {name_of(refers_to, digest)}"] if named else []), f"{REFERS}: {refers_to}"]
    if page_id is not None:
        head.append(f"{PAGE}: {page_id}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class Members:
    """The gzip members of a stream, read from front to back; a member's bytes come in pieces of PIECE at most."""

    def __init__(self, stream: BinaryIO, chunk: int = 1 << 16):
        self.stream, self.chunk, self.rest = stream, chunk, b""

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self.rest or (chunk := self.stream.read(self.chunk)):
            self.rest = self.rest or chunk
            pieces = self._pieces()
            yield pieces
            for _ in pieces:  # what the caller left unread
                pass

    def _pieces(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            data = unpack.unconsumed_tail or self.rest or self.stream.read(self.chunk)
            self.rest = b""
            if not data:
                raise WarcError("the archive ends inside a record")
            try:
                piece = unpack.decompress(data, PIECE)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            if piece:
                yield piece
        self.rest = unpack.unused_data


def right_digest(want: str, data: bytes) -> bool:
    """Whether data has the digest `algorithm:value`, in hex or base32; one of an unknown algorithm can't be wrong."""
    name, _, value = want.partition(":")
    try:
        found = hashlib.new(name.strip().lower().replace("-", ""), data).digest()
    except (ValueError, TypeError):
        return True
    return _plain(value) == found.hex()


def _plain(value: str) -> str:
    """A digest in lower-case hex, from hex or base32; as it is where it is neither."""
    value = value.strip()
    try:
        if len(value) == 32 and not set(value.upper()) <= set("0123456789ABCDEF"):
            return base64.b32decode(value.upper()).hex()
    except ValueError:
        pass
    return value.lower()


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of any type; the length frames it while it is decompressed, the digests are verified."""
    for pieces in Members(stream):
        head = bytearray()
        while (cut := head.find(b"\r\n\r\n")) < 0:
            if len(head) > LONGEST_HEAD or (piece := next(pieces, None)) is None:
                raise WarcError("no WARC header")
            head += piece
        lines = bytes(head[:cut]).decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("no WARC header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        name = fields.get("warc-record-id")
        if not (size := fields.get("content-length", "")).isdigit():
            raise WarcError(f"no length: {name}")
        block, end = head[cut + 4 :], int(size) + 4
        while len(block) < end and (piece := next(pieces, None)) is not None:
            block += piece
        if len(block) != end or block[-4:] != b"\r\n\r\n" or next(pieces, None) is not None:
            raise WarcError(f"wrongly framed: {name}")
        del block[-4:]
        block = bytes(block)
        if (want := fields.get("warc-block-digest")) and not right_digest(want, block):
            raise WarcError(f"block digest: {name}")
        if fields.get("warc-type") == "response" and (want := fields.get("warc-payload-digest")) and not right_digest(want, payload_of(fields, block)):
            raise WarcError(f"payload digest: {name}")
        yield fields, block


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP head, if it is an HTTP message."""
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "application/http").lower().startswith("application/http") else block


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit), record_id.

    Page ids are those of this writer's fields; those of other writers' records are null, and the record ids tell. The bytes of a revisit's payload are what its HTTP
    head says, null where that says nothing.
    """
    kind, payload = fields["warc-type"], payload_of(fields, block)
    size = len(payload)
    if kind == "revisit":
        lengths = (x.split(b":", 1)[1].strip() for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        size = next((int(x) for x in lengths if x.isdigit()), None)
    digest = fields.get("warc-payload-digest", "")
    digest = _plain(digest.partition(":")[2]) if digest else hashlib.sha1(payload).hexdigest() if kind != "revisit" else None
    return _number(fields.get(PAGE.lower())), fields.get("warc-target-uri"), size, digest, kind, _number(fields.get(REFERS.lower())), None if kind == "revisit" else payload, fields.get("warc-record-id")


def _number(value: str | None) -> int | None:
    return int(value) if value and value.removeprefix("-").isdecimal() else None


def write(pages: DataFrame, folder: str) -> DataFrame:
    """path, records, bytes of the archives written to folder (a URI that the executors reach), one row each.

    Of rows with equal payloads of LEAST_SHARED bytes or more that with the largest page_id is a response, the others revisit
    it, by its record id; rows that share that id as well are all responses (the revisits then name the page alone), as are all rows of a group without ids. Null html is empty. The
    groups are found by digest and size alone, with map-side maxima and a join that can be split, so no group meets in one task.
    An archive is written under another name and then renamed, so a lost or repeated task leaves no half archive.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    each = rows.filter(F.col("size") >= LEAST_SHARED).groupBy("digest", "size", "page_id").agg(F.count(F.lit(1)).alias("times"))
    last = each.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.sum("times").alias("n"), F.max_by("times", "page_id").alias("times")).filter("n > 1").drop("n")
    rows = rows.join(last, ["digest", "size"], "left")
    rows = rows.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last")))
    rows = rows.withColumn("named", F.coalesce(F.col("times") == 1, F.lit(False)))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def work(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, done = None, []

        def close():
            name = f"{base}/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{name}.open", compression=None) as f:
                f.write(out[0].getvalue())
            done.append((name, f"{folder}/{name.rpartition('/')[2]}.warc.gz", out[1], out[0].tell()))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "named")), strict=True):
                out = out or [io.BytesIO(), 0]
                out[0].write(record(*row))
                out[1] += 1
                if out[0].tell() >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out:
            close()
        for name, *_ in done:
            fs.move(f"{name}.open", f"{name}.warc.gz")
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*done, strict=True))[1:], schema, strict=True)], schema=schema)

    return rows.select("page_id", "url", "payload", "digest", "refers_to", "named").mapInArrow(work, "path string, records long, bytes long")


_PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string"


def read(spark: SparkSession, paths: DataFrame | str, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, record_id of the records of these kinds.

    paths: a frame with a column `path` (what write() returned, kept: archives of task attempts that lost out stay unread), or a
    folder, whose archives a task lists. Tasks open the archives themselves and read each from front to back, so nothing of them
    passes through the driver. Records of other kinds (warcinfo, request, metadata) are checked and left out. A record that fails a check
    raises WarcError.
    """
    ship(spark)
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    schema = pa.schema(list(zip([x.split()[0] for x in _PAGE.split(", ")], types, strict=True)))

    def listed(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                fs, base = pyarrow.fs.FileSystem.from_uri(folder)
                found = (x.base_name for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.base_name.endswith(".warc.gz"))
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{n}" for n in found], pa.string())], names=["path"])

    def parse(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, base = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(base, compression=None) as f:
                    for fields, block in records(f):
                        if fields.get("warc-type") in kinds:
                            rows.append(page_of(fields, block))
                            held += len(block) + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    if isinstance(paths, str):
        paths = settled(spark.createDataFrame([(paths,)], "path string").mapInArrow(listed, "path string"))
    n = paths.count()
    return paths.select("path").repartition(max(1, min(n, 100_000))).mapInArrow(parse, _PAGE)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to of each row.

    Null html is an empty payload, a very long one is a record like any other; a null page_id comes back null; an empty table gives no rows;
    repeated rows come back repeated; other columns are left aside.
    """
    written = settled(write(pages, scratch(pages.sparkSession)))
    return read(pages.sparkSession, written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
