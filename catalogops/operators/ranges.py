"""Running sums over sorted ranges, so that no task holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.plans.staging import written


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same keys up to and with each one.

    Rows are sorted into ranges by keys and order; sums run within a range, and a key that goes on over
    the border of a range takes along what the ranges before it add up to.  Keys are not null; rows that are equal in keys and order
    come in any order.
    """
    ranged = rows.withColumn("__v", value.cast("long")).orderBy(*keys, *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    within = F.sum("__v").over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy("__part", *keys).agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # A range has at most one key that began in an earlier one: no more rows than ranges.
    carried = sums.withColumn("__before", before).where("__before is not null").drop("__s")
    out = ranged.withColumn(name, within).join(F.broadcast(carried), ["__part", *keys], "left")
    return out.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__part", "__v", "__before").select(*rows.columns, name)
