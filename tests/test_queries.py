"""Every registered query of the library against DuckDB on the smallest tables, and a few plans."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

from tabulon import registry
from tabulon.operators.ordering import with_ord
from tabulon.operators.reshape import CellError, choose_columns, random_array, take, wrap_rows
from tabulon.plans.parser import FormulaError
from tabulon.plans.table_formula import table_formula

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(frame):
    """Rows as sorted tuples, numbers rounded, whatever type a number has."""

    def cell(v):
        if not isinstance(v, list | np.ndarray) and pd.isna(v):
            return (1, "")
        if isinstance(v, int | float | np.number) and not isinstance(v, bool):
            return (0, round(float(v), 6) + 0.0)
        return (2, str(v))

    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        assert _rows(found) == _rows(duck.execute(sql).df())


def test_formula_errors(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "ord long, x double")
    code = lambda text: table_formula({"t": rows}, text).select("error").first()[0]
    assert code("=TAKE(t,0)") == "#CALC!" and code("=CHOOSECOLS(t,3)") == "#VALUE!" and code("=EXPAND(t,1)") == "#VALUE!" and code("=XLOOKUP(1,t.x,t.x,,2,2)") == "#VALUE!"
    assert code("=NOSUCH(t.x)") == "#NAME?" and code("=VLOOKUP(1,t,0)") == "#VALUE!"
    for bad in ("=SORT(", "=FILTER(t)", "=SCAN(0,t.x,LAMBDA(a,v,a-v))"):
        with pytest.raises((FormulaError, IndexError)):
            table_formula({"t": rows}, bad)
    with pytest.raises(FormulaError):
        table_formula({"t": rows.drop("ord")}, "=SUM(t.x)")
    for call in (lambda: take(rows, 0), lambda: choose_columns(rows, 0), lambda: wrap_rows(rows, 0), lambda: random_array(spark, 1, 1, 2.0, 1.0)):
        with pytest.raises(CellError):
            call()


def test_criteria_reach_the_scan(spark):
    plan = registry.queries()["sumifs_lineitem"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(l_returnflag, [R,r])" in plan.split("PushedFilters", 1)[1] and "GreaterThanOrEqual(l_quantity,10.0)" in plan


def test_row_numbers(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(13)
    assert [r["ord"] for r in with_ord(rows, "k", "id").orderBy("k", "id").collect()] == list(range(1, 1001))
    assert with_ord(rows.where("false"), "id").count() == 0
