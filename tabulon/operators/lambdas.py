"""LAMBDA forms: bodies are Python functions of Columns, inlined when the plan is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions.values import bind
from tabulon.operators.ordering import before_parts, in_order

#: Running folds that a window or an aggregate does, by operator.
ASSOCIATIVE = {"+": F.sum, "max": F.max, "min": F.min, "*": F.product}
JOINED: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}


def makearray(spark: SparkSession, rows: int, columns: int, body: Callable[[Column, Column], Column]) -> DataFrame:
    """Cells body(row, column), 1-based; one column of the frame for each of the grid."""
    i = (F.col("id") + 1).cast("double")
    return spark.range(rows).select((F.col("id") + 1).alias("ord"), *[body(i, F.lit(float(k + 1))).alias(f"c{k + 1}") for k in range(columns)])


def map_rows(frame: DataFrame, out: str, body: Callable[..., Column], *columns: str) -> DataFrame:
    return frame.withColumn(out, body(*[F.col(c) for c in columns]))


def scan(frame: DataFrame, column: str, how: str, by: list[str], order: list[str], out: str = "running") -> DataFrame:
    """SCAN with an associative body: a running window in each ``by`` group.

    Without groups the rows are sorted over ranges: each range has its own window and starts from
    the total of the ranges before it, so no task holds all rows.
    """
    fold = ASSOCIATIVE[how]
    if by:
        return frame.withColumn(out, fold(F.col(column)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    placed = in_order(frame, *order)
    totals = placed.groupBy("_part").agg(fold(F.col(column)).alias("_total"))
    before = before_parts(totals, fold(F.col("_total")), "_before")
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", fold(F.col(column)).over(inside)).join(F.broadcast(before), "_part")
    joined = F.when(F.col("_before").isNull(), F.col("_own")).when(F.col("_own").isNull(), F.col("_before")).otherwise(JOINED[how](F.col("_before"), F.col("_own")))
    return own.withColumn(out, joined).drop("_own", "_before", "_part", "_place")


def scan_array(values: Column, init: Column, body: Callable[[Column, Column], Column]) -> Column:
    """SCAN of an array with any body, which is evaluated once a cell."""
    start = F.struct(init.alias("acc"), F.array().cast("array<double>").alias("all"))
    step = lambda s, v: bind([body(s["acc"], v)], lambda x: F.struct(x.alias("acc"), F.array_append(s["all"], x).alias("all")))
    return F.aggregate(values, start, step, lambda s: s["all"])


def reduce_array(values: Column, init: Column, body: Callable[[Column, Column], Column]) -> Column:
    """REDUCE of an array, left to right."""
    return F.aggregate(values, init, body)


def byrow(frame: DataFrame, out: str, body: Callable[[Column], Column], *columns: str) -> DataFrame:
    """body of the array of a row's cells."""
    return frame.withColumn(out, body(F.array(*[F.col(c).cast("double") for c in columns])))


def bycol(frame: DataFrame, body: Callable[[Column], Column], *columns: str) -> DataFrame:
    """body of each whole column, an aggregate."""
    return frame.agg(*[body(F.col(c)).alias(c) for c in columns])
