"""Sending this package's source to executors, which need not share the driver's files."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once per application: Python workers can import the package from then on. Arrow batches are kept small."""
    sc = spark.sparkContext
    # Python workers hold a few copies of a batch; a quarter of Spark's default keeps them small with long texts.
    if spark.conf.get(_BATCH_BYTES, f"{64 << 20}b") == f"{64 << 20}b":
        spark.conf.set(_BATCH_BYTES, f"{16 << 20}b")
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    # The driver's own temporary file: Spark's file server hands its bytes to the executors.
    path = os.path.join(tempfile.mkdtemp(prefix="leafwright-"), f"leafwright_{uuid.uuid4().hex[:8]}.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
