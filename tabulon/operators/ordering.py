"""Row positions. Worksheet arrays are ordered; here the order is an explicit column ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id has the partition above this many bits, and the place in it below.
_PLACE_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session (of one machine) uses its warehouse; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def stable(frame: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared checkpoint folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def in_order(frame: DataFrame, *keys: Column | str) -> DataFrame:
    """The rows in key order, kept, with ``_part`` and ``_place``: the partition and the place in it.

    One range-partitioned sort; the numbers come from where a row lies after it.
    """
    at = F.col("_at")
    kept = stable(frame.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()))
    return kept.withColumn("_part", F.shiftright(at, _PLACE_BITS)).withColumn("_place", at.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_at")


def before_parts(totals: DataFrame, value: Column, out: str) -> DataFrame:
    """For each ``_part`` of totals (one row each), value over the parts before it."""
    return totals.select("_part", value.over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias(out))


def with_ord(frame: DataFrame, *keys: Column | str) -> DataFrame:
    """Number the rows from 1 in key order.

    A row's number is its place in its partition of the sorted rows, and the rows of the
    partitions before. No window runs over all rows; the counts, one row a partition, are what
    is broadcast.
    """
    placed = in_order(frame, *keys)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before_parts(counts, F.sum("_n"), "_before")
    return placed.join(F.broadcast(before), "_part").withColumn("ord", F.coalesce("_before", F.lit(0)) + F.col("_place") + 1).drop("_part", "_place", "_before")
