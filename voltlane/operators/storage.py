"""Where intermediate results go when a plan must be cut."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folders made for each application, so that a caller can remove them when its results are written.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name that every executor can reach: under ``spark.checkpoint.dir``, or, where that is not set, under
    the session's warehouse, which all executors share too. Never under a machine's own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/voltlane-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read back. Cuts the lineage in a way that survives lost executors, and makes later
    passes see the very same rows in the very same files."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_intermediates(spark: SparkSession) -> int:
    """Delete the folders made so far; frames built on them can no longer be read. Returns how many there were."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def release_memory() -> None:
    """Give free memory of this process back to the machine; Python workers live longer than their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
