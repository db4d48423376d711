"""Sends this package to the executors of a session that may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context.

    Arrow batches are bounded by bytes as well, since texts may be very long, unless the session has a bound.
    """
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.sparkContext.getConf().toDebugString():
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_assayer_shipped", False):
        return
    top = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="assayer-"), "assayer_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, f"{top.name}/{source.relative_to(top)}")
    context.addPyFile(path)
    context._assayer_shipped = True
