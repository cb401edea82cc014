"""What the operators of this subpackage share: hashing, bounded label samples, portions of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..store import discard, passing, recorded, scratch, settled  # noqa: F401  what the operators of this subpackage use


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, key: str = "doc_id"):
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "utf-8")) % n


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, wanted, per_class: int, most_chars: int | None = None) -> DataFrame:
    """(doc_id, text, label) of rows of at most per_class labelled ids of either class that satisfy wanted; rows with equal ids all come, see one_per_id.

    Drawn by the hash of the id, so reruns agree. The ids are at most 2 * per_class, which bounds the broadcast.
    most_chars leaves longer texts out of this sample, for operators that bring its texts to one task.
    """
    labels = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(wanted & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    pick = lambda k: labels.filter(f"label = {k}").distinct().orderBy(*order).limit(per_class)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if most_chars:
        docs = docs.filter(F.length("text") <= most_chars)
    return docs.join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id")


def one_per_id(rows: DataFrame, value: str, order: str) -> DataFrame:
    """value and label of one row of each (doc_id, label), that of the smallest `order`: what bounds a sample where ids repeat. Combined at the map side."""
    return rows.groupBy("doc_id", "label").agg(F.min(F.struct(order, value)).alias("b")).select("doc_id", "label", f"b.{value}")


def odds_shift(labels: DataFrame, label: str, wanted, y: np.ndarray) -> float:
    """What takes log odds in a balanced sample with labels y to those of all labels that satisfy wanted; 0 where either has one class."""
    share = labels.filter(wanted & F.col(label).cast("int").isin(0, 1) & F.col("doc_id").isNotNull()).agg(F.avg(F.col(label).cast("int"))).first()[0]
    if not len(y) or share is None or not (0 < share < 1 and 0 < y.mean() < 1):
        return 0.0
    return float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))


def row_and_text(docs: DataFrame, keep: list[str] | None, *more: Column) -> DataFrame:
    """row (a struct of the columns of docs, or of keep), text where the row doesn't have it, and more."""
    ship(docs.sparkSession)
    names = keep or docs.columns
    text = [] if "text" in names else ["text"]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *text, *more)


def portions(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with about `most` bytes of text, and their texts (null: empty), so that what is made of them stays small."""
    for batch in batches:
        names = batch.schema.names
        texts = batch.column("text") if "text" in names else batch.column("row").field("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start), [t or "" for t in texts.slice(start, stop - start).to_pylist()]
            start = stop
