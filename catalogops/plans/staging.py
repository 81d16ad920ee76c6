"""Written intermediate tables in the folder that all executors share.

A table written here cuts lineage: the loss of an executor costs a re-read,
not a recomputation.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) is a local
one chosen.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
#: Bytes of a batch that Spark hands to Python; a single larger row is still whole.
BATCH_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared between driver and executors."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        base = spark.sparkContext.getCheckpointDir() or ""
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "catalogops-scratch")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`scratch_dir`."""
    path = f"{scratch_dir(spark)}/catalogops/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it reread."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._catalogops_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read again."""
    path = getattr(df, "_catalogops_path", None)
    if path:
        discard_path(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this driver; results read later are lost."""
    for path in list(_written):
        discard_path(spark, path)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete what was written at a path of :func:`scratch_path`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand batches of at most ``BATCH_BYTES`` (or one row) to Python in this session, if it would hand larger ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")  # a user's own setting with a unit stays
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
