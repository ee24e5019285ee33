"""Queries of the worksheet functions and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.criteria import criterion, sumifs_where
from tabulon.plans import cell_queries, formula_queries, scalar_queries, stream_queries, table_queries


def _sumifs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tests = (criterion(F.col("l_returnflag"), "text", "r"), criterion(F.col("l_quantity"), "number", ">=10"))
    return sumifs_where(rows, "l_extendedprice", *tests).select(F.round("value", 2).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"sumifs_lineitem": _sumifs_lineitem} | scalar_queries.queries() | table_queries.queries() | cell_queries.queries() | formula_queries.queries() | stream_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {
        "sumifs_lineitem": "SELECT round(coalesce(sum(l_extendedprice), 0), 2)::DOUBLE AS total FROM lineitem "
        "WHERE l_returnflag = 'R' AND l_quantity >= 10"
    } | scalar_queries.oracle_sql() | table_queries.oracle_sql() | cell_queries.oracle_sql() | formula_queries.oracle_sql() | stream_queries.oracle_sql()
