"""Queries of formulas over tables: one for each function that takes ranges, and for its modes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.ordering import with_ord
from tabulon.plans.table_formula import table_formula

#: Tables of the formulas: columns, and the order of the rows.
TABLES = {
    "part": (("p_partkey", "p_name", "p_size", "p_retailprice"), ("p_partkey",)),
    "nation": (("n_nationkey", "n_name", "n_regionkey"), ("n_nationkey",)),
    "customer": (("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), ("c_custkey",)),
    "lines": (("l_quantity", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")),
}
_FILES = {"lines": "lineitem"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, keys = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{_FILES.get(name, name)}.parquet")
    return with_ord(rows.select(*dict.fromkeys([*columns, *keys])), *keys).select("ord", *columns)


def _sql(name: str) -> str:
    columns, keys = TABLES[name]
    return f"(SELECT row_number() OVER (ORDER BY {', '.join(keys)}) AS ord, {', '.join(columns)} FROM {_FILES.get(name, name)})"


_P, _N, _C = _sql("part"), _sql("nation"), _sql("customer")
_ONE = "NULL::VARCHAR AS error"

#: Query name to tables, formula and SQL.
FORMULAS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "sum": (("lines",), "=SUM(lines.l_quantity)+SUM(lines.l_linenumber,lines.l_quantity,5)", f"SELECT (2 * sum(l_quantity) + sum(l_linenumber) + 5)::DOUBLE AS value, {_ONE} FROM lineitem"),
    "product": (("part",), "=ROUND(PRODUCT(1+part.p_size/100000),6)", f"SELECT round(product(1 + p_size / 100000), 6) AS value, {_ONE} FROM part"),
    "average": (("part",), "=ROUND(AVERAGE(part.p_size,part.p_retailprice),6)", f"SELECT round((sum(p_size) + sum(p_retailprice)) / (2 * count(*)), 6) AS value, {_ONE} FROM part"),
    "average_of_text": (("part",), "=AVERAGE(part.p_name)", "SELECT NULL::DOUBLE AS value, '#DIV/0!' AS error"),
    "min_max": (("part",), "=MAX(part.p_size,part.p_partkey)-MIN(part.p_retailprice)", f"SELECT greatest(max(p_size), max(p_partkey)) - min(p_retailprice) AS value, {_ONE} FROM part"),
    "counts": (("part",), "=COUNT(part.p_name,part.p_size)&\"/\"&COUNTA(part.p_name)&\"/\"&COUNTBLANK(part.p_name)", f"SELECT count(*) || '/' || count(*) || '/0' AS value, {_ONE} FROM part"),
    "sumproduct": (("lines",), "=SUMPRODUCT(lines.l_quantity,lines.l_linenumber,lines.l_returnflag=\"r\")+SUMPRODUCT((lines.l_quantity>10)*lines.l_linenumber)", f"SELECT (sum(CASE WHEN l_quantity > 10 THEN l_linenumber ELSE 0 END))::DOUBLE AS value, {_ONE} FROM lineitem"),
    "sumif": (("lines",), "=SUMIF(lines.l_quantity,\">=10\")-SUMIF(lines.l_returnflag,\"R\",lines.l_linenumber)", f"SELECT (coalesce(sum(l_quantity) FILTER (WHERE l_quantity >= 10), 0) - coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'R'), 0))::DOUBLE AS value, {_ONE} FROM lineitem"),
    "sumifs": (("lines",), "=SUMIFS(lines.l_quantity,lines.l_returnflag,\"<>n\",lines.l_linenumber,2)", f"SELECT coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'N' AND l_linenumber = 2), 0)::DOUBLE AS value, {_ONE} FROM lineitem"),
    "countif": (("part",), "=COUNTIF(part.p_name,\"r*g\")", f"SELECT count(*) FILTER (WHERE p_name ILIKE 'r%g')::DOUBLE AS value, {_ONE} FROM part"),
    "countifs": (("part",), "=COUNTIFS(part.p_name,\"s*\",part.p_size,\"<20\")", f"SELECT count(*) FILTER (WHERE p_name ILIKE 's%' AND p_size < 20)::DOUBLE AS value, {_ONE} FROM part"),
    "averageif": (("part",), "=ROUND(AVERAGEIF(part.p_size,\">40\",part.p_retailprice),6)", f"SELECT round(avg(p_retailprice) FILTER (WHERE p_size > 40), 6) AS value, {_ONE} FROM part"),
    "averageifs_none": (("part",), "=AVERAGEIFS(part.p_size,part.p_size,\">999\")", "SELECT NULL::DOUBLE AS value, '#DIV/0!' AS error"),
    "and_or_xor": (("part",), "=AND(part.p_size)&OR(part.p_size>49)&XOR(part.p_size=7)", f"SELECT CASE WHEN bool_and(p_size <> 0) THEN 'TRUE' ELSE 'FALSE' END || CASE WHEN bool_or(p_size > 49) THEN 'TRUE' ELSE 'FALSE' END || CASE WHEN count(*) FILTER (WHERE p_size = 7) % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END AS value, {_ONE} FROM part"),
    "row_by_row": (("part",), "=IF(part.p_size>AVERAGE(part.p_size),UPPER(part.p_name),part.p_size*2)", f"SELECT ord, CASE WHEN p_size > (SELECT avg(p_size) FROM part) THEN upper(p_name) ELSE (2 * p_size)::VARCHAR END AS value, {_ONE} FROM {_P}"),
    "filter": (("part",), "=FILTER(part,(part.p_size>40)*(part.p_name<>\"small ring\"))", f"SELECT ord, p_partkey AS c1, p_name AS c2, p_size AS c3, p_retailprice AS c4 FROM {_P} WHERE p_size > 40 AND p_name <> 'small ring'"),
    "filter_columns": (("part",), "=FILTER(part,{TRUE,FALSE,1,0})", f"SELECT ord, p_partkey AS c1, p_size AS c2 FROM {_P}"),
    "sort": (("part",), "=SORT(part,3,-1)", f"SELECT row_number() OVER (ORDER BY p_size DESC, ord) AS ord, p_partkey AS c1, p_name AS c2, p_size AS c3, p_retailprice AS c4 FROM {_P}"),
    "sortby": (("part",), "=SORTBY(part.p_partkey,part.p_name,1,part.p_size,-1)", f"SELECT row_number() OVER (ORDER BY lower(p_name), p_size DESC, ord) AS ord, p_partkey AS c1 FROM {_P}"),
    "unique": (("part",), "=UNIQUE(part.p_name)", f"SELECT row_number() OVER (ORDER BY min(ord)) AS ord, min_by(p_name, ord) AS c1 FROM {_P} GROUP BY lower(p_name)"),
    "unique_once": (("customer",), "=UNIQUE(customer.c_acctbal,,TRUE)", f"SELECT row_number() OVER (ORDER BY min(ord)) AS ord, c_acctbal AS c1 FROM {_C} GROUP BY c_acctbal HAVING count(*) = 1"),
    "take_sort_filter": (("part",), "=TAKE(SORT(FILTER(part,part.p_size>40),4,-1),10,-2)", f"SELECT row_number() OVER (ORDER BY p_retailprice DESC, ord) AS ord, p_size AS c1, p_retailprice AS c2 FROM {_P} WHERE p_size > 40 ORDER BY p_retailprice DESC, {_P}.ord LIMIT 10".replace(f"{_P}.ord", "p_partkey")),
    "drop": (("part",), "=DROP(part,-25,1)", f"SELECT ord, p_name AS c1, p_size AS c2, p_retailprice AS c3 FROM {_P} WHERE ord <= (SELECT count(*) FROM part) - 25"),
    "choosecols": (("part",), "=CHOOSECOLS(part,-1,1,1)", f"SELECT ord, p_retailprice AS c1, p_partkey AS c2, p_partkey AS c3 FROM {_P}"),
    "chooserows": (("nation",), "=CHOOSEROWS(nation,{5,-1},2)", f"SELECT pos AS ord, n_nationkey AS c1, n_name AS c2, n_regionkey AS c3 FROM {_N} JOIN (VALUES (1::BIGINT, 5), (2, 25), (3, 2)) t(pos, o) ON ord = o"),
    "vstack": (("nation", "part"), "=VSTACK(nation.n_name,part.p_name)", f"SELECT row_number() OVER (ORDER BY s, ord) AS ord, c1 FROM (SELECT 0 AS s, ord, n_name AS c1 FROM {_N} UNION ALL SELECT 1, ord, p_name FROM {_P})"),
    "hstack": (("nation", "part"), "=HSTACK(part.p_name,nation.n_name)", f"SELECT ord, p_name AS c1, n_name AS c2, NULL::VARCHAR AS _error0, CASE WHEN n_name IS NULL THEN '#N/A' END AS _error1 FROM {_P} LEFT JOIN {_N} USING (ord)"),
    "tocol": (("part",), "=TOCOL(CHOOSECOLS(part,3,4),0,TRUE)", f"SELECT (k - 1) * (SELECT count(*) FROM part) + ord AS ord, CASE k WHEN 1 THEN p_size ELSE p_retailprice END::DOUBLE AS c1 FROM {_P}, (VALUES (1), (2)) t(k)"),
    "torow": (("nation",), "=TOROW(nation.n_regionkey)", "SELECT 1::BIGINT AS ord, list(n_regionkey ORDER BY n_nationkey)::VARCHAR AS c1 FROM nation"),
    "wraprows": (("part",), "=WRAPROWS(part.p_size,2,0)", f"SELECT (ord - 1) // 2 + 1 AS ord, max(p_size) FILTER (WHERE ord % 2 = 1)::INTEGER AS c1, coalesce(max(p_size) FILTER (WHERE ord % 2 = 0), 0)::INTEGER AS c2 FROM {_P} GROUP BY 1"),
    "wrapcols": (("nation",), "=WRAPCOLS(nation.n_nationkey,13,99)", "SELECT n_nationkey % 13 + 1 AS ord, min(n_nationkey)::INTEGER AS c1, CASE WHEN count(*) > 1 THEN max(n_nationkey) ELSE 99 END::INTEGER AS c2 FROM nation GROUP BY 1"),
    "expand": (("nation",), "=EXPAND(nation.n_nationkey,30,2,-1)", "SELECT range AS ord, coalesce(n_nationkey, -1)::INTEGER AS c1, -1.0::DOUBLE AS c2, NULL::VARCHAR AS error FROM range(1, 31) LEFT JOIN nation ON n_nationkey = range - 1"),
    "sequence": ((), "=SEQUENCE(500,2,10,-0.5)", "SELECT range + 1 AS ord, 10 - range::DOUBLE AS c1, 9.5 - range::DOUBLE AS c2 FROM range(500)"),
    "randarray": ((), "=MAP(RANDARRAY(400,1,3,3,TRUE),LAMBDA(x,x*2))", f"SELECT range AS ord, 6.0::DOUBLE AS c1, {_ONE} FROM range(1, 401)"),
    "makearray": ((), "=MAKEARRAY(300,2,LAMBDA(r,c,IF(r=c,1,r*c)))", "SELECT range AS ord, range::DOUBLE AS c1, CASE WHEN range = 2 THEN 1 ELSE range * 2 END::DOUBLE AS c2 FROM range(1, 301)"),
    "map": (("part",), "=MAP(part.p_name,part.p_size,LAMBDA(a,b,LEFT(a,b)))", f"SELECT ord, left(p_name, p_size) AS c1, {_ONE} FROM {_P}"),
    "scan": (("part",), "=SCAN(100,part.p_size,LAMBDA(a,v,a+v))", f"SELECT ord, 100 + sum(p_size) OVER (ORDER BY ord)::DOUBLE AS c1 FROM {_P}"),
    "scan_max": (("part",), "=SCAN(,part.p_retailprice,LAMBDA(a,v,MAX(a,v)))", f"SELECT ord, max(p_retailprice) OVER (ORDER BY ord) AS c1 FROM {_P}"),
    "reduce": (("part",), "=REDUCE(7,part.p_size,LAMBDA(a,v,a+v))", f"SELECT (7 + sum(p_size))::DOUBLE AS value, {_ONE} FROM part"),
    "byrow": (("part",), "=BYROW(CHOOSECOLS(part,1,3),LAMBDA(r,SUM(r)/COUNT(r)))", f"SELECT ord, (p_partkey + p_size) / 2 AS c1, {_ONE} FROM {_P}"),
    "byrow_named": (("part",), "=BYROW(part,MAX)", f"SELECT ord, greatest(p_partkey, p_size, p_retailprice)::DOUBLE AS c1, {_ONE} FROM {_P}"),
    "bycol": (("part",), "=BYCOL(CHOOSECOLS(part,3,4),LAMBDA(c,MAX(c)-MIN(c)))", "SELECT 1::BIGINT AS ord, (max(p_size) - min(p_size))::DOUBLE AS c1, max(p_retailprice) - min(p_retailprice) AS c2, NULL::VARCHAR AS c1_error, NULL::VARCHAR AS c2_error FROM part"),
    "vlookup_exact": (("nation", "customer"), "=VLOOKUP(customer.c_nationkey,nation,2,FALSE)", f"SELECT ord, n_name AS c1, {_ONE} FROM {_C} LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "vlookup_nearest": (("part", "customer"), "=VLOOKUP(customer.c_acctbal,SORT(CHOOSECOLS(part,4,1)),2)", f"SELECT c.ord, k AS c1, CASE WHEN k IS NULL THEN '#N/A' END AS error FROM {_C} c ASOF LEFT JOIN (SELECT p_retailprice, max(p_partkey) AS k FROM part GROUP BY 1) ON c_acctbal >= p_retailprice"),
    "vlookup_outside": (("nation",), "=VLOOKUP(1,nation,9,FALSE)", "SELECT NULL::DOUBLE AS value, '#REF!' AS error"),
    "hlookup": (("nation",), "=HLOOKUP(\"0\",nation,4,FALSE)", "SELECT 1::BIGINT AS ord, n_nationkey::VARCHAR AS c1, NULL::VARCHAR AS error FROM nation WHERE n_nationkey = 3"),
    "xlookup": (("nation", "customer"), "=XLOOKUP(customer.c_nationkey,FILTER(nation.n_nationkey,nation.n_nationkey>4),FILTER(nation.n_name,nation.n_nationkey>4),\"none\")", f"SELECT ord, coalesce(n_name, 'none') AS c1, {_ONE} FROM {_C} LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey > 4"),
    "xlookup_last": (("part", "nation"), "=XLOOKUP(nation.n_nationkey,part.p_size,part.p_partkey,,0,-1)", f"SELECT ord, k AS c1, CASE WHEN k IS NULL THEN '#N/A' END AS error FROM {_N} LEFT JOIN (SELECT p_size, max(p_partkey) AS k FROM part GROUP BY 1) ON p_size = n_nationkey"),
    "xlookup_larger": (("part", "customer"), "=XLOOKUP(customer.c_acctbal,part.p_retailprice,part.p_partkey,-1,1)", f"SELECT c.ord, coalesce(k, -1) AS c1, {_ONE} FROM {_C} c ASOF LEFT JOIN (SELECT p_retailprice, min(p_partkey) AS k FROM part GROUP BY 1) ON c_acctbal <= p_retailprice"),
    "xlookup_wildcard": (("part",), "=XLOOKUP(\"?mall r*\",part.p_name,part.p_partkey,,2)", "SELECT 1::BIGINT AS ord, min(p_partkey) AS c1, CASE WHEN count(*) = 0 THEN '#N/A' END AS error FROM part WHERE p_name ILIKE '_mall r%'"),
    "match": (("part",), "=MATCH(\"r*t\",part.p_name,0)", f"SELECT min(ord) AS value, CASE WHEN count(*) = 0 THEN '#N/A' END AS error FROM {_P} WHERE p_name ILIKE 'r%t'"),
    "match_sorted": (("part",), "=MATCH(30,SORT(part.p_size),1)", "SELECT nullif(count(*), 0) AS value, CASE WHEN count(*) = 0 THEN '#N/A' END AS error FROM part WHERE p_size <= 30"),
    "match_keys": (("nation", "customer"), "=MATCH(customer.c_nationkey,nation.n_nationkey,0)", f"SELECT ord, (c_nationkey + 1)::BIGINT AS c1, {_ONE} FROM {_C}"),
    "index": (("nation",), "=INDEX(nation,7,2)", f"SELECT n_name AS value, {_ONE} FROM nation WHERE n_nationkey = 6"),
    "let_lambda": (("part",), "=LET(f,LAMBDA(x,y,ISOMITTED(y)),m,MAX(part.p_size),IF(f(1,),m*2,0))", f"SELECT (max(p_size) * 2)::DOUBLE AS value, {_ONE} FROM part"),
}


def _query(names: tuple[str, ...], formula: str, as_text: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = table_formula({n: _table(spark, sf_dir, n) for n in names}, formula)
        return found.select("ord", F.concat(F.lit("["), F.array_join("c1", ", "), F.lit("]")).alias("c1")) if as_text else found

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"formula_{name}": _query(names, formula, name == "torow") for name, (names, formula, _) in FORMULAS.items()}


def oracle_sql() -> dict[str, str]:
    return {f"formula_{name}": sql for name, (_, _, sql) in FORMULAS.items()}
