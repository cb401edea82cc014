"""Folders that all executors share: scratch paths, results written once and read back."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship


#: Folders of applications on one machine that name none.
_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir.

    Only a session of one machine without that setting (a test) gets a temporary folder of its own; on a cluster the setting must be there,
    as other executors don't see what a task writes to its own disk.
    """
    app = ship(spark).sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app.applicationId)
    if not root:
        if not app.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own[app.applicationId] = "file://" + tempfile.mkdtemp(prefix="affinis-")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    for made in _recordings():
        made.append(path)
    return path


_of_thread = threading.local()


def _recordings() -> list[list[str]]:
    """The lists that this thread records into; others' paths are none of its business."""
    if not hasattr(_of_thread, "lists"):
        _of_thread.lists = []
    return _of_thread.lists


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the paths that scratch() gives this thread meanwhile, for a caller that knows when nothing reads them any more."""
    made: list[str] = []
    _recordings().append(made)
    try:
        yield made
    finally:
        _of_thread.lists = [x for x in _of_thread.lists if x is not made]


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end, also after an error, the folders that scratch() gave in it, but for those that the body puts into the list.

    For work whose result is settled before the end: nothing that is read later may lie in the other folders.
    """
    keep: list[str] = []
    with recorded() as made:
        try:
            yield keep
        finally:
            for path in made:
                if path not in keep:
                    discard(spark, path)


def settled(df: DataFrame, level: int = 3, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder (to path, if given; in a folder for each value of the columns `by`) and read back: computed once, and safe from lost executors. level: of the compression."""
    path = path or scratch(df.sparkSession)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str | None) -> None:
    """Removes what settled() wrote to path and nothing reads any more."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
