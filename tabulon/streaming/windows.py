"""Criteria aggregates over event-time windows of a stream.

A typed-column formula (``tabulon.plans.formula.with_formula``) is a plain expression and works on a
stream as it is. Aggregates need an end to wait for: rows are grouped by windows of their event
time, and a watermark says how late a row may come before its window is closed and its state
let go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.ordering import shared_folder


def windowed(events: DataFrame, time: str, *, width: str, late: str, slide: str | None = None, by: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """``start``, ``end``, the ``by`` columns and the aggregates of each window.

    Rows without an event time are in no window. The same frame works on a batch.
    """
    timed = events.where(F.col(time).isNotNull()).withWatermark(time, late)
    span = F.window(time, width, slide) if slide else F.window(time, width)
    made = timed.groupBy(span.alias("_window"), *(by or [])).agg(*[c.alias(k) for k, c in aggregates.items()])
    return made.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *(by or []), *aggregates)


def drain(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into Parquet in the shared folder, and read that.

    Windows that the watermark has closed are written; offsets and state are kept beside them, so
    a run that is started again with the same ``path`` goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def read_stream(spark: SparkSession, folder: str, pattern: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files in a folder whose names fit the pattern, of the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(folder)
