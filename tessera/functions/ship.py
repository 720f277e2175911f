"""Sends this package to the executors, so that Python functions find it wherever the driver was started, and bounds what they hold at once."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: Rows in an Arrow batch. Texts may be long, so a batch holds few rows.
BATCH_ROWS = 256
#: Bytes in an Arrow batch, besides its last row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the rows of its partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def send(context: SparkContext | None = None) -> None:
    """Once for each context; Spark serves the archive from the driver. The active session gets small batches each time, in a thread without one the default session."""
    context = context or SparkContext._active_spark_context
    session = SparkSession.getActiveSession() or (SparkSession.builder.getOrCreate() if context is not None else None)
    if session is not None:
        small_batches(session)
    if context is None or getattr(context, "_tessera_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp()}/{package.name}_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    context._tessera_sent = True
