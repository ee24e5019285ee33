"""Queries of the cell lane: the case corpus, and small workbooks made from table rows."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.plans.verify import by_file, formulas, verdicts
from tabulon.sources.cases import read_cases



def _cases_dir() -> str:
    """The folder of JSON cases: as TABULON_CASES names it, or ``fixtures`` with a schema in a folder beside this installation's."""
    beside = sorted(Path(__file__).resolve().parents[3].glob("*/fixtures/schema.json"))
    return os.environ.get("TABULON_CASES") or (str(beside[0].parent) if beside else "")


CASES_DIR = _cases_dir()


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the whole corpus by file."""
    return by_file(verdicts(read_cases(spark, CASES_DIR)))


_CASES_SQL = rf"""
SELECT regexp_extract(filename, '([^/]+/[^/]+)\.json$', 1) AS file,
       count(*) FILTER (json_extract_string(c, '$.ignore') IS NULL) AS "pass", 0::BIGINT AS fail, 0::BIGINT AS failed_to_run,
       count(*) FILTER (json_extract_string(c, '$.ignore') IS NOT NULL) AS ignored
FROM (SELECT filename, unnest(CASE WHEN json_type(content) = 'ARRAY' THEN json_extract(content, '$[*]')
                              WHEN json_extract(content, '$.cases') IS NOT NULL THEN json_extract(content, '$.cases[*]') ELSE [content::JSON] END) AS c
      FROM read_text('{CASES_DIR}/**/*.json') WHERE filename NOT LIKE '%schema.json')
GROUP BY 1
"""


def _order_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a workbook: a row a line with quantity, price and discount, and a formula cell for the net price."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = lambda column: F.concat(F.lit(column), F.row_number().over(by_order))
    from pyspark.sql import Window

    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    row = F.row_number().over(by_order).cast("string")
    number = lambda c: F.to_json(F.struct(F.col(c).alias("number")))
    net = F.concat(F.lit('{"formula":"=ROUND(B'), row, F.lit("*(1-C"), row, F.lit('),4)"}'))
    cells = F.array(*[F.concat(F.lit('"'), place(c), F.lit('":'), body) for c, body in (("A", number("l_quantity")), ("B", number("l_extendedprice")), ("C", number("l_discount")), ("D", net))])
    made = lines.select("l_orderkey", F.concat_ws(",", cells).alias("cells"), row.cast("int").alias("row"))
    books = made.groupBy("l_orderkey").agg(F.concat_ws(",", F.collect_list("cells")).alias("cells"), F.max("row").cast("string").alias("n"))
    return books.select("l_orderkey", F.concat(F.lit('{"sheets":[{"name":"Lines","cells":{'), "cells", F.lit("}}]}")).alias("book"), "n")


def _workbook_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = _order_books(spark, sf_dir)
    text = F.concat(F.lit("=ROUND(SUMIF(A1:A"), "n", F.lit(',">=10",D1:D'), "n", F.lit(")+COUNTA(A1:A"), "n", F.lit("),2)"))
    found = formulas(books.withColumn("formula", text), "formula", "book")
    return found.select("l_orderkey", F.get_json_object("value", "$.number").cast("double").alias("value"))


_WORKBOOK_SQL = """
SELECT l_orderkey, round((coalesce(sum(round(l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(4,2)), 4)) FILTER (WHERE l_quantity >= 10), 0) + count(*))::DECIMAL(18,4), 2)::DOUBLE AS value
FROM lineitem GROUP BY 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"workbook_sums": _workbook_sums}
    if os.path.isdir(CASES_DIR):
        out["cases_by_file"] = _cases
    return out


def oracle_sql() -> dict[str, str]:
    out = {"workbook_sums": _WORKBOOK_SQL}
    if os.path.isdir(CASES_DIR):
        out["cases_by_file"] = _CASES_SQL
    return out
