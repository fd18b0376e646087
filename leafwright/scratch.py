"""Written intermediate tables: what is used twice, or must not be asked for twice, is Parquet in a shared folder.

The folder is below ``spark.checkpoint.dir``, which all machines of a cluster share. Only where Spark runs in one
process on this machine is a local folder made if that is unset; elsewhere that is an error, as executors would
each write to their own disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder; it is removed when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _scratch:
        base = sc.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            base = tempfile.mkdtemp(prefix="leafwright-checkpoints-")
            sc.setCheckpointDir(base)
        at = f"{base.rstrip('/')}/leafwright-{uuid.uuid4().hex[:12]}"
        _scratch[sc.applicationId] = at
        atexit.register(_remove, spark, at)
    return _scratch[sc.applicationId]


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have ended first; the folder is then left for the cluster's own cleaning
        pass


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return a reader of it: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
