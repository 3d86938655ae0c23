"""Sending this package to Python workers, which may run where it isn't installed."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from skeinlake.operators.graph import scratch_dir

HERE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's source to all workers, once for an application.

    The archive lies in the shared folder and is written through Spark's own file system, so any store does.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(HERE.rglob("*.py")):
            archive.write(file, file.relative_to(HERE.parent))
    where = f"{scratch_dir(spark)}/{HERE.name}-{context.applicationId}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    context.addPyFile(path.makeQualified(path.getFileSystem(context._jsc.hadoopConfiguration()).getUri(), path).toString())
    _sent.add(context.applicationId)
