"""Streams of uploads, reactions and edit bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.functions import scalars as S
from catalogops.operators.catalog import upload_status
from catalogops.operators.manifests import free_names
from catalogops.plans.staging import discard, written

#: Where uploads go below their root, and the columns of a catalog.
GUESTS = "guests"
CATALOG = "name string, path string, type string"


def accepted_uploads(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Valid uploads ``(ts, root, name, size)`` with a sanitised name and the dir they go to, the ``guests`` of their root.

    Uploads that share a name are all kept.  Only where events have an ``event_id`` is one that is delivered again
    within the watermark dropped.
    """
    named = upload_status(events).where("reject_reason is null").withColumn("name", S.sanitise_name(F.col("name"))).withColumn("dir", F.concat("root", F.lit("/" + GUESTS)))
    return named.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]) if "event_id" in events.columns else named


def rejected_uploads(events: DataFrame) -> DataFrame:
    return upload_status(events).where("reject_reason is not null")


def name_batch(batch: DataFrame, catalog: DataFrame, dest: str | None = None) -> DataFrame:
    """Catalog rows ``(name, path, type)`` of a batch of uploads ``(ts, name)`` under names that are free in the dir ``dest`` (else in each row's ``dir``)."""
    where = F.lit(dest) if dest is not None else F.col("dir")
    taken = catalog.select(S.basename(F.col("path")).alias("name"), S.dirname(F.col("path")).alias("dir"))
    new = batch.select(F.col("ts").alias("ord"), "name", where.alias("dir"))
    # Of the catalog only the dirs that get uploads count.
    named = free_names(new, taken.join(new.select("dir").distinct().hint("merge"), "dir", "left_semi"))
    kind = F.when(S.has_format(F.col("stored"), S.UPLOADED_VIDEO), "video").otherwise("image")
    return named.select(F.col("stored").alias("name"), F.concat("dir", F.lit("/"), "stored").alias("path"), kind.alias("type"))


class UploadSink:
    """``foreachBatch`` sink that gives uploads free names and keeps them as a table, one folder a batch.

    A batch sees the catalog and the batches before it, and replaces what an earlier run of itself has
    left, so a replayed batch neither loses nor doubles an upload.
    """

    def __init__(self, path: str, catalog: DataFrame | None = None):
        self.path, self.catalog = path.rstrip("/"), catalog

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch_id={batch_id}"

    def stored(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Uploads ``(name, path, type)`` of all batches, or of those before one."""
        spark.createDataFrame([], CATALOG + ", batch_id long").write.mode("append").partitionBy("batch_id").parquet(self.path)
        rows = spark.read.schema(CATALOG + ", batch_id long").parquet(self.path)
        return (rows if before is None else rows.where(F.col("batch_id") < before)).drop("batch_id")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = self.stored(spark, batch_id)
        known = known.unionByName(self.catalog.select("name", "path", "type")) if self.catalog is not None else known
        # Read by several jobs, and a stream's batch is worked out anew by each.
        batch = written(batch.select("ts", "name", "dir"), "upload-batch")
        name_batch(batch, known).write.mode("overwrite").parquet(self._folder(batch_id))
        discard(batch)


def collapse_bursts(events: DataFrame, gap: str = "500 milliseconds", watermark: str = "1 minute", key: str = "key") -> DataFrame:
    """The last value of each burst of a key: events closer than the gap are one burst. Works on batches too."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    burst = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("n"))
    return burst.select(key, F.col("w.start").alias("start"), "value", "n")


def latest_values(events: DataFrame, key: str = "key") -> DataFrame:
    """Latest value of each key; run in update or complete mode."""
    return events.groupBy(key).agg(F.max_by("value", "ts").alias("value"))
