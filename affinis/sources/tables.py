"""Readers and writers: spectra by column aliases, candidate tables, structure files, array files, submissions, reports."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import finite
from ..operators.kernels import cleaned
from ..operators.ranking import first_of, top_n
from ..shipping import ship

CANDIDATE = ("candidate_id", "smiles", "canonical_smiles", "inchikey14", "formula", "exact_mass", "source")


def aliased(df: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """df with logical names: of each the first alias that df has. Missing required ones are an error that lists them."""
    found = {name: next((a for a in options if a in df.columns), None) for name, options in aliases.items()}
    if missing := sorted(n for n in required if not found.get(n)):
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*[F.col(f"`{a}`").alias(n) for n, a in found.items() if a])


def read_spectra(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str], molecules: list[str] | DataFrame | None = None, molecule: str = "molecule_id") -> DataFrame:
    """Spectra under logical names, those of some molecules if given: a short list is a filter that reaches the scan, a frame a semi-join."""
    rows = aliased(spark.read.parquet(path), aliases, required)
    if isinstance(molecules, DataFrame):
        return rows.join(molecules.select(molecule).distinct(), molecule, "left_semi")
    return rows if molecules is None else rows.filter(F.col(molecule).isin(list(molecules)))


def in_input_order(spark: SparkSession, path: str, name: str = "input_order") -> DataFrame:
    """A Parquet table with `name`, a struct of file and row that sorts as its rows were written: ties go by it where the first of equals is to win. It comes from the files' metadata,
    so it costs no sort, and any partitioning and any cluster give the same. Files count by their name."""
    rows = spark.read.parquet(path)
    if name in rows.columns:
        raise ValueError(f"the table has a column {name}")
    return rows.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")).alias(name))


def iterated(rows: DataFrame, batch_size: int = 4096, prefetch: bool = True) -> Iterator[list[Row]]:
    """Lists of batch_size rows, the last one shorter, for a caller who works through a table outside Spark: a partition at a time comes to the driver (with prefetch the next one
    too), in the order of the partitions, so memory is that of one or two partitions, whatever the table's size. Column pruning and filters of `rows` hold as ever."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    arriving = rows.toLocalIterator(prefetchPartitions=prefetch)
    while batch := list(islice(arriving, batch_size)):
        yield batch


def read_manifest(spark: SparkSession, path: str, required: list[str] = ("molecule_id",)) -> DataFrame:
    """A CSV of one row for each molecule; required columns that lack are an error, as are repeated ids."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    if missing := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"columns are missing: {missing}")
    if twice := [r[0] for r in rows.groupBy(required[0]).count().filter("count > 1").limit(5).collect()]:
        raise ValueError(f"repeated {required[0]}: {twice}")
    return rows


def preprocessed(rows: DataFrame, key: Column, mass: Column, **cleaning) -> DataFrame:
    """rows (peaks, precursor_mz) with cleaned peaks, num_peaks, the structure's key and the neutral mass; spectra without a peak left are dropped."""
    out = rows.withColumn("peaks", cleaned(F.col("peaks"), F.col("precursor_mz"), **cleaning)).withColumn("num_peaks", F.size("peaks"))
    return out.filter("num_peaks > 0").withColumn("key", F.substring(key, 1, 14)).withColumn("mass", mass)


def read_candidates(spark: SparkSession, path: str, schema: str, separator: str | None = None, source: str | None = None) -> DataFrame:
    """A candidate table; source, if given, names where its rows come from."""
    rows = spark.read.csv(path, header=True, schema=schema, sep=separator or ("\t" if path.endswith(".tsv") else ","))
    return rows if source is None else rows.withColumn("source", F.lit(source))


def candidate_counts(sources: list[DataFrame], merged: DataFrame) -> dict[str, int]:
    """How many rows came in, were valid, and are left."""
    came = [s.agg(F.count(F.lit(1))).first()[0] for s in sources]
    good = [valid(s.withColumn("inchikey14", F.substring("inchikey14", 1, 14))).count() for s in sources]
    left = merged.count()
    return {"read": sum(came), "valid": sum(good), "written": left, "dropped": sum(came) - left}


def valid(rows: DataFrame) -> DataFrame:
    """Rows with a structure, a key of 14 characters and a finite positive mass."""
    return rows.filter(F.col("canonical_smiles").isNotNull() & (F.col("canonical_smiles") != "") & (F.length("inchikey14") == 14) & finite(F.col("exact_mass")) & (F.col("exact_mass") > 0))


def merged_candidates(sources: list[DataFrame]) -> DataFrame:
    """The union, one row for each key: sources that come first win, then the lowest candidate id."""
    rows = None
    for i, s in enumerate(sources):
        part = valid(s.withColumn("inchikey14", F.substring("inchikey14", 1, 14))).withColumn("priority", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return first_of(rows, ["inchikey14"], F.col("priority"), F.col("candidate_id")).drop("priority")


def read_sdf(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """record, properties (map) of each structure of .sdf or .sdf.gz files, `most` at most; records without properties are left out.

    A value goes on to the next blank line; of a property that repeats the first counts.
    """
    rows = spark.read.option("lineSep", "$$$$\n").text(path).withColumnRenamed("value", "record")
    item = F.lit(r">[ \t]*<([^>]+)>[^\n]*\n((?:[^\n]*\S[^\n]*(?:\n|$))*)")
    names, values = F.regexp_extract_all("record", item, F.lit(1)), F.regexp_extract_all("record", item, F.lit(2))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("key"), F.regexp_replace(v, r"\s+$", "").alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    rows = rows.withColumn("properties", F.map_from_entries(first)).filter(F.size("properties") > 0)
    return rows if most is None else rows.limit(most)


@contextmanager
def _archive(path: str) -> Iterator[zipfile.ZipFile]:
    """A zip file on any file system that Arrow knows; only what is asked for is read."""
    if path.startswith("file:"):
        system, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as file, zipfile.ZipFile(file) as z:
        yield z


def _array_in(z: zipfile.ZipFile, name: str) -> tuple[zipfile.ZipExtFile, int, np.dtype, int]:
    """A one-dimensional array of an archive as a stream, where its values begin, their type and how many there are."""
    stream = z.open(f"{name}.npy")
    version = np.lib.format.read_magic(stream)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if len(shape) != 1:
        raise ValueError("not one-dimensional arrays of equal length")
    if kind.hasobject:
        raise ValueError(f"{name} holds objects, which are not read (allow_pickle is off)")
    return stream, stream.tell(), kind, shape[0]


def read_arrays(spark: SparkSession, path: str, schema: str, rows_per_task: int = 1 << 22, batch_size: int = 1 << 16) -> DataFrame:
    """Rows of .npz files, whose arrays are the columns of schema; arrays of other shapes or lengths are an error. Nothing in them is executed.

    A file is read in ranges of rows_per_task rows by several tasks, and a range in batches, so that files may be larger than any memory. Where an array is
    compressed its file is one range, still in batches, as what lies in the middle can't be reached without what comes before.
    """
    if rows_per_task < 1 or batch_size < 1:
        raise ValueError("rows_per_task and batch_size must be at least 1")
    empty = ship(spark).createDataFrame([], schema)
    names = empty.columns

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                with _archive(file) as z:
                    if missing := sorted(set(names) - {n.removesuffix(".npy") for n in z.namelist()}):
                        raise ValueError(f"arrays are missing: {missing}")
                    rows = {_array_in(z, n)[3] for n in names}
                    packed = any(z.getinfo(f"{n}.npy").compress_type != zipfile.ZIP_STORED for n in names)
                if len(rows) > 1:
                    raise ValueError("not one-dimensional arrays of equal length")
                (n,) = rows
                first = np.arange(0, n, n if packed else rows_per_task) if n else np.zeros(0, np.int64)
                last = np.minimum(first + (n if packed else rows_per_task), n)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(first), pa.string()), pa.array(first), pa.array(last)], names=["path", "first", "last"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with ExitStack() as held:
                    # Each array has the file opened for itself, as streams of one archive would share a position.
                    arrays = [_array_in(held.enter_context(_archive(r["path"])), n) for n in names]
                    for stream, start, kind, _ in arrays:
                        stream.seek(start + r["first"] * kind.itemsize)
                    for at in range(r["first"], r["last"], batch_size):
                        n = min(batch_size, r["last"] - at)
                        parts = [np.frombuffer(stream.read(n * kind.itemsize), kind) for stream, _, kind, _ in arrays]
                        yield pa.RecordBatch.from_arrays([pa.array(a.astype(a.dtype.newbyteorder("="))) for a in parts], names=names)

    files = spark.read.format("binaryFile").load(path).select("path").mapInArrow(ranges, "path string, first long, last long")
    # A range is a row: spread over tasks by their number, which isn't made smaller because the rows are.
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "first").mapInArrow(work, empty.schema)


def save_index(rows: DataFrame, path: str, kind: str, order: str | None = None, **about) -> None:
    """An index as Parquet, in ranges of `order`, with its kind and what else is to be known beside it. What is there already is an error."""
    write_parquet(rows, f"{path}/rows", order)
    meta = json.dumps({"kind": kind, **about}, sort_keys=True)
    rows.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def load_index(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, dict]:
    """The rows of an index and what is known of it; one of another kind is an error."""
    about = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if about["kind"] != kind:
        raise TypeError(f"{path} is a {about['kind']}, not a {kind}")
    return spark.read.parquet(f"{path}/rows"), about


def submission(rows: DataFrame, most: int = 25) -> DataFrame:
    """molecule_id, smiles: each molecule's first `most` different structures in order of rank, joined by semicolons."""
    once = rows.groupBy("molecule_id", "inchikey14").agg(F.min(F.struct("rank", "smiles")).alias("b"))
    kept = top_n(once, ["molecule_id"], most, F.col("b.rank"), F.col("inchikey14"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("top_rank", F.col("b.smiles").alias("s")))), lambda x: x["s"])
    return kept.groupBy("molecule_id").agg(F.array_join(listed, ";").alias("smiles"))


def check_submission(rows: DataFrame, expected: DataFrame, most: int = 25) -> DataFrame:
    """molecule_id, fault for all that is wrong: ids missing, unknown or repeated; no, too many, blank or repeated structures."""
    parts = F.split("smiles", ";")
    fault = F.when(F.col("smiles").isNull() | F.exists(parts, lambda x: F.trim(x) == ""), "blank").when(F.size(parts) > most, "too_many").when(F.size(F.array_distinct(parts)) < F.size(parts), "repeated_structure")
    out = rows.select("molecule_id", fault.alias("fault")).filter("fault is not null")
    out = out.unionByName(expected.join(rows, "molecule_id", "left_anti").select("molecule_id", F.lit("missing").alias("fault")))
    out = out.unionByName(rows.join(expected, "molecule_id", "left_anti").select("molecule_id", F.lit("unknown").alias("fault")))
    return out.unionByName(rows.groupBy("molecule_id").count().filter("count > 1").select("molecule_id", F.lit("repeated_id").alias("fault")))


def write_parquet(rows: DataFrame, path: str, order: str | None = None) -> None:
    """zstd, and in ranges of `order`, so that row groups can be skipped by it. Committed as a whole or not at all."""
    if order:
        rows = rows.repartitionByRange(order).sortWithinPartitions(order)
    rows.write.option("compression", "zstd").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.csv(path, header=True)


def report(row: DataFrame) -> str:
    """JSON of a frame of one row."""
    return json.dumps(row.first().asDict(recursive=True), sort_keys=True)


def bundle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path (inside the folder), bytes, sha256 of every file under a folder; files are read on the executors, each in one piece."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    return files.select(F.element_at(F.split("path", re.escape(root) + "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bundle_faults(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """path, fault: files of the manifest that are missing or changed, and files that it doesn't know."""
    now = bundle_manifest(spark, folder).select("path", F.col("sha256").alias("now"))
    both = manifest.select("path", "sha256").join(now, "path", "full")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("path", fault.alias("fault")).filter("fault is not null")
