"""The package on the executors: Python workers import it by name."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tidemark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of the session, once for each context; Spark's file server hands it out."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(tidemark.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-package-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._tidemark_shipped = True
