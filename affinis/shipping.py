"""Makes this package importable in the Python workers, wherever the session was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the application, once; a package that came as an archive is there already."""
    context, folder = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId not in _done and folder.is_dir():
        _done.add(context.applicationId)
        archive = f"{tempfile.mkdtemp(prefix='affinis-')}/affinis-sources.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(folder.rglob("*.py")):
                z.write(p, p.relative_to(folder.parent))
        context.addPyFile(archive)
    return spark
