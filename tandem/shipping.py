"""Send this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Make ``import tandem`` work in the session's Python workers; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tandem_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tandem-ship-")) / "tandem.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(to))
    context._tandem_shipped = True
    return spark
