"""Queries of the table-level functions, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import tabulon.functions.finance as M
import tabulon.operators.cashflow as W
import tabulon.operators.aggregate as A
import tabulon.operators.criteria as C
import tabulon.operators.lambdas as B
import tabulon.operators.lookup as K
import tabulon.operators.reshape as R
from tabulon.functions.values import Val
from tabulon.operators.ordering import with_ord

Run = Callable[[SparkSession, str], DataFrame]
TABLE: dict[str, tuple[Run, str | None]] = {}


def _add(name: str, run: Run, sql: str | None) -> None:
    TABLE[name] = (run, sql)


def _read(name: str) -> Run:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


_line, _part, _cust, _ord, _nation, _events = (_read(n) for n in ("lineitem", "part", "customer", "orders", "nation", "events"))


def _exact(c: str) -> Column:
    """Money as decimal, so that sums do not depend on their order."""
    return F.col(c).cast("decimal(18,4)")


def _agg(name: str, make: Callable[[], dict[str, Column]], sql: str) -> None:
    _add(name, lambda s, d: _line(s, d).groupBy("l_returnflag").agg(*[c.alias(k) for k, c in make().items()]), f"SELECT l_returnflag, {sql} FROM lineitem GROUP BY 1")


_some = lambda: F.when(F.col("l_linenumber") > 2, F.col("l_quantity"))
_SOME = "CASE WHEN l_linenumber > 2 THEN l_quantity END"
_agg("fn_sum", lambda: {"value": A.total(_some())}, f"coalesce(sum({_SOME}), 0)::DOUBLE AS value")
# factors near 1 from every row: their product stays finite, and is rounded where the order of factors may show
_agg("fn_product", lambda: {"value": F.round(A.product(1 + (F.col("l_tax") - 0.04) / 1000), 9)}, "round(coalesce(product(1 + (l_tax - 0.04) / 1000), 0), 9)::DOUBLE AS value")
_agg("fn_average", lambda: {"value": F.round(A.average(_some()).v, 6), "error": A.average(_some()).e}, f"round(avg({_SOME}), 6) AS value, NULL::VARCHAR AS error")
_agg("fn_min", lambda: {"value": A.least(_some())}, f"coalesce(min({_SOME}), 0)::DOUBLE AS value")
_agg("fn_max", lambda: {"value": A.greatest(_some())}, f"coalesce(max({_SOME}), 0)::DOUBLE AS value")
_agg("fn_count", lambda: {"value": A.count_numbers(_some())}, f"count({_SOME}) AS value")
_agg("fn_counta", lambda: {"value": A.count_filled(F.nullif(F.col("l_linestatus"), F.lit("O")))}, "count(nullif(l_linestatus, 'O')) AS value")
_agg("fn_countblank", lambda: {"value": A.count_blank(_some())}, f"count(*) FILTER (WHERE ({_SOME}) IS NULL) AS value")
_agg(
    "fn_sumproduct",
    lambda: {"value": F.round(A.sumproduct(F.col("l_extendedprice"), 1 - F.col("l_discount"), F.col("l_quantity") >= 10), 2)},
    "round(coalesce(sum(l_extendedprice * (1 - l_discount) * (l_quantity >= 10)::INTEGER), 0), 2)::DOUBLE AS value",
)
_agg("fn_sumproduct_quantities", lambda: {"value": A.sumproduct(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_quantity") > 10)}, "sum(l_quantity * l_linenumber * (l_quantity > 10)::INTEGER)::DOUBLE AS value")
_agg("fn_and_range", lambda: {"value": A.all_true(F.col("l_quantity") - 1)}, "coalesce(bool_and(l_quantity <> 1), true) AS value")
_agg("fn_or_range", lambda: {"value": A.any_true(F.col("l_tax"))}, "coalesce(bool_or(l_tax <> 0), false) AS value")
_agg("fn_xor_range", lambda: {"value": A.odd_true(F.col("l_tax"))}, "count(*) FILTER (WHERE l_tax <> 0) % 2 = 1 AS value")

_crit = C.criterion
_flag = lambda: _crit(F.col("l_linestatus"), "text", "o*")
_big = lambda: _crit(F.col("l_quantity"), "number", ">=10")
_agg("fn_sumif", lambda: {"value": C.sumifs(F.col("l_quantity"), _big())}, "coalesce(sum(l_quantity) FILTER (WHERE l_quantity >= 10), 0)::DOUBLE AS value")
_agg("fn_sumifs", lambda: {"value": C.sumifs(F.col("l_quantity"), _big(), _flag())}, "coalesce(sum(l_quantity) FILTER (WHERE l_quantity >= 10 AND l_linestatus ILIKE 'o%'), 0)::DOUBLE AS value")
_agg("fn_countif", lambda: {"value": C.countifs(_crit(F.col("l_linestatus"), "text", "<>F"))}, "count(*) FILTER (WHERE l_linestatus <> 'F') AS value")
_agg("fn_countifs", lambda: {"value": C.countifs(_big(), _flag())}, "count(*) FILTER (WHERE l_quantity >= 10 AND l_linestatus ILIKE 'o%') AS value")
_avg = lambda *t: {"value": F.round(C.averageifs(F.col("l_quantity"), *t).v, 6), "error": C.averageifs(F.col("l_quantity"), *t).e}
_agg("fn_averageif", lambda: _avg(_flag()), "round(avg(l_quantity) FILTER (WHERE l_linestatus ILIKE 'o%'), 6) AS value, CASE WHEN count(*) FILTER (WHERE l_linestatus ILIKE 'o%') = 0 THEN '#DIV/0!' END AS error")
_agg("fn_averageifs", lambda: _avg(_big(), _flag()), "round(avg(l_quantity) FILTER (WHERE l_quantity >= 10 AND l_linestatus ILIKE 'o%'), 6) AS value, CASE WHEN count(*) FILTER (WHERE l_quantity >= 10 AND l_linestatus ILIKE 'o%') = 0 THEN '#DIV/0!' END AS error")

# look-ups
_lookup = lambda **o: lambda s, d: K.lookup_exact(_cust(s, d).select("c_custkey", "c_nationkey"), "c_nationkey", _nation(s, d).withColumn("gap", F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey"))), "gap", "n_name", "n_nationkey", **o).select("c_custkey", "found", "error")
_add("fn_xlookup", _lookup(if_missing="none"), "SELECT c_custkey, coalesce(n_name, 'none') AS found, NULL::VARCHAR AS error FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 6 <> 0")
_add("fn_vlookup", _lookup(), "SELECT c_custkey, n_name AS found, CASE WHEN n_name IS NULL THEN '#N/A' END AS error FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 6 <> 0")
_add(
    "fn_xlookup_last",
    lambda s, d: K.lookup_exact(_events(s, d).select("user_id").distinct(), "user_id", _events(s, d).withColumnRenamed("user_id", "u"), "u", "value", "event_id", last=True).select("user_id", "found"),
    "SELECT user_id, arg_max(value, event_id) AS found FROM events GROUP BY 1",
)


# whole-number edges, so that many parts share one: VLOOKUP takes the last of them, XLOOKUP the first
_edges = lambda s, d: _part(s, d).select((F.floor("p_retailprice") * 300).cast("double").alias("edge"), "p_partkey")
_near = lambda at, **o: lambda s, d: K.lookup_nearest(_ord(s, d).select("o_orderkey", "o_totalprice"), "o_totalprice", _edges(s, d), "edge", "p_partkey", at, **o).select("o_orderkey", "found", "error")
_NEAR = "SELECT o_orderkey, band AS found, CASE WHEN band IS NULL THEN '#N/A' END AS error FROM orders ASOF LEFT JOIN (SELECT floor(p_retailprice) * 300 AS edge, {}(p_partkey) AS band FROM part GROUP BY 1) ON o_totalprice {} edge"
_add("fn_vlookup_nearest", _near("p_partkey"), _NEAR.format("max", ">="))
_add("fn_xlookup_smaller", _near("p_partkey", exact_first=True), _NEAR.format("min", ">="))
_add("fn_xlookup_larger", _near("p_partkey", larger=True, exact_first=True), _NEAR.format("min", "<="))
_add(
    "fn_vlookup_nearest_text",
    lambda s, d: K.lookup_nearest(_cust(s, d).select("c_custkey", "c_mktsegment"), "c_mktsegment", _nation(s, d).select(F.initcap("n_name").alias("head"), "n_nationkey"), "head", "n_nationkey", "n_nationkey").select("c_custkey", "found", "error"),
    "SELECT c_custkey, n_nationkey AS found, CASE WHEN n_nationkey IS NULL THEN '#N/A' END AS error FROM customer ASOF LEFT JOIN (SELECT lower(n_name) AS head, n_nationkey FROM nation) ON lower(c_mktsegment) >= head",
)
_add(
    "fn_xlookup_wildcard",
    lambda s, d: K.lookup_wildcard(_nation(s, d).select("n_nationkey", F.concat(F.lower(F.substring("n_name", 8, 1)), F.lit("*t?l*")).alias("pattern")), "pattern", _part(s, d), "p_name", "p_partkey", "p_partkey").select("n_nationkey", "found", "error"),
    "SELECT n_nationkey, min(p_partkey) AS found, CASE WHEN min(p_partkey) IS NULL THEN '#N/A' END AS error FROM nation LEFT JOIN part ON p_name ILIKE lower(substring(n_name, 8, 1)) || '%t_l%' GROUP BY n_nationkey",
)
_wide = lambda s, d: with_ord(_nation(s, d).groupBy("n_regionkey").agg(F.min("n_name").alias("a"), F.max("n_name").alias("b"), F.count("*").cast("string").alias("c")), "n_regionkey").select("ord", "a", "b", "c")
_heads = lambda s, d: _wide(s, d).where("ord = 1").select(F.posexplode(F.array("b", "c", F.lit("none"), "a")).alias("pos", "head"))
_add(
    "fn_hlookup",
    lambda s, d: K.hlookup(_heads(s, d), "head", _wide(s, d), "ord", 3).select("pos", "found", "error"),
    "WITH w AS (SELECT row_number() OVER (ORDER BY n_regionkey) AS ord, min(n_name) AS a, max(n_name) AS b, count(*)::VARCHAR AS c FROM nation GROUP BY n_regionkey), "
    "h AS (SELECT unnest([0, 1, 2, 3])::INTEGER AS pos, unnest([b, c, 'none', a]) AS head FROM w WHERE ord = 1), x AS (SELECT unnest([a, b, c]) AS head, unnest([1, 2, 3]) AS k FROM w WHERE ord = 1), y AS (SELECT unnest([a, b, c]) AS found, unnest([1, 2, 3]) AS k FROM w WHERE ord = 3) "
    "SELECT pos, found, CASE WHEN found IS NULL THEN '#N/A' END AS error FROM h LEFT JOIN (SELECT head, min(k) AS k FROM x GROUP BY 1) USING (head) LEFT JOIN y USING (k)",
)
_places = lambda s, d: with_ord(_part(s, d), "p_retailprice", "p_partkey")
_add("fn_match_sorted", lambda s, d: K.match_place(_places(s, d), "p_retailprice", 1500.0, "ord", 1), "SELECT nullif(count(*), 0) AS value, CASE WHEN count(*) = 0 THEN '#N/A' END AS error FROM part WHERE p_retailprice <= 1500")
_add("fn_match_falling", lambda s, d: K.match_place(with_ord(_part(s, d), "p_partkey"), "p_name", "S", "ord", -1), "SELECT min(r) AS value, CASE WHEN min(r) IS NULL THEN '#N/A' END AS error FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE lower(p_name) >= 's'")
_add("fn_match", lambda s, d: K.match_wildcard(with_ord(_part(s, d), "p_partkey"), "p_name", "r*g?t", "ord"), "SELECT min(r) AS value, CASE WHEN min(r) IS NULL THEN '#N/A' END AS error FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE p_name ILIKE 'r%g_t'")
_add("fn_index", lambda s, d: K.index_row(with_ord(_part(s, d), "p_partkey"), "ord", 17, "p_name"), "SELECT any_value(p_name) AS value, CASE WHEN count(*) = 0 THEN '#REF!' END AS error FROM (SELECT p_name FROM part ORDER BY p_partkey LIMIT 1 OFFSET 16)")
_add("fn_index_outside", lambda s, d: K.index_row(with_ord(_nation(s, d), "n_nationkey"), "ord", 26, "n_name"), "SELECT NULL::VARCHAR AS value, '#REF!' AS error")

# dynamic arrays; every array is the parts in key order
_grid = lambda s, d: with_ord(_part(s, d).select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey")
_GRID = "(SELECT row_number() OVER (ORDER BY p_partkey) AS ord, p_partkey, p_name, p_size, p_retailprice FROM part)"
_add("fn_filter", lambda s, d: R.filter_rows(_grid(s, d), F.col("p_size") > 40), f"SELECT * FROM {_GRID} WHERE p_size > 40")
_add("fn_sort", lambda s, d: with_ord(_grid(s, d).withColumnRenamed("ord", "was"), *R.sort_keys("p_size", "number", -1), "was").select("ord", "p_partkey"), f"SELECT row_number() OVER (ORDER BY p_size DESC, ord) AS ord, p_partkey FROM {_GRID}")
_add("fn_sortby", lambda s, d: with_ord(_grid(s, d).withColumnRenamed("ord", "was"), *R.sort_keys("p_name", "text", 1), *R.sort_keys("p_size", "number", -1), "was").select("ord", "p_partkey"), f"SELECT row_number() OVER (ORDER BY lower(p_name), p_size DESC, ord) AS ord, p_partkey FROM {_GRID}")
_add("fn_unique", lambda s, d: R.unique_rows(_grid(s, d), ["p_name"]), f"SELECT min(ord) AS ord, p_name FROM {_GRID} GROUP BY p_name")
_add("fn_unique_once", lambda s, d: R.unique_rows(_grid(s, d), ["p_name", "p_size"], once=True), f"SELECT min(ord) AS ord, p_name, p_size FROM {_GRID} GROUP BY p_name, p_size HAVING count(*) = 1")
_add("fn_tocol", lambda s, d: R.to_column(_grid(s, d), ["p_size", "p_retailprice"]), f"SELECT (ord - 1) * 2 + k AS ord, CASE k WHEN 1 THEN p_size ELSE p_retailprice END::DOUBLE AS value FROM {_GRID}, (VALUES (1), (2)) t(k)")
_add("fn_tocol_by_column", lambda s, d: R.to_column(_grid(s, d).withColumn("p_size", F.nullif("p_size", F.lit(7))), ["p_size", "p_retailprice"], skip_blanks=True, by_column=True), f"SELECT (k - 1) * (SELECT count(*) FROM part) + ord AS ord, CASE k WHEN 1 THEN nullif(p_size, 7) ELSE p_retailprice END::DOUBLE AS value FROM {_GRID}, (VALUES (1), (2)) t(k) WHERE k = 2 OR p_size <> 7")
# a row for each brand, since a row of a sheet is bounded
_branded = lambda s, d: with_ord(_part(s, d), "p_partkey")
_add("fn_torow", lambda s, d: R.to_row(_branded(s, d), ["p_size", "p_partkey"], ["p_brand"]).select("p_brand", F.array_join("cells", ",").alias("value")), "SELECT p_brand, string_agg(p_size || ',' || p_partkey, ',' ORDER BY p_partkey) AS value FROM part GROUP BY 1")
_add("fn_sequence", lambda s, d: R.sequence(s, 1000, 2, 5.0, 3.0), "SELECT range + 1 AS ord, (5 + range * 2 * 3)::DOUBLE AS c1, (5 + (range * 2 + 1) * 3)::DOUBLE AS c2 FROM range(1000)")
_add("fn_vstack", lambda s, d: R.vstack(_grid(s, d).select("ord", "p_name", "p_size"), _grid(s, d).select("ord", "p_name")), f"SELECT 0 AS src, ord, p_name AS c1, p_size AS c2, NULL::VARCHAR AS c2_error FROM {_GRID} UNION ALL SELECT 1, ord, p_name, NULL, '#N/A' FROM {_GRID}")
_suppliers = lambda s, d: with_ord(_read("supplier")(s, d).select("s_suppkey", "s_name"), "s_suppkey")
_add(
    "fn_hstack",
    lambda s, d: R.hstack(_grid(s, d).select("ord", "p_name"), _suppliers(s, d).select("ord", "s_name"), with_ord(_nation(s, d), "n_nationkey").select("ord", "n_name")),
    f"SELECT ord, p_name, s_name, n_name, CASE WHEN p_partkey IS NULL THEN '#N/A' END AS _error0, CASE WHEN s_suppkey IS NULL THEN '#N/A' END AS _error1, CASE WHEN n_nationkey IS NULL THEN '#N/A' END AS _error2 FROM {_GRID} "
    "FULL JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS ord FROM supplier) USING (ord) FULL JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS ord FROM nation) USING (ord)",
)
_vector = lambda s, d: _grid(s, d).select("ord", F.col("p_size").alias("value"))
_add("fn_wraprows", lambda s, d: R.wrap_rows(_vector(s, d), 3, -1), f"SELECT (ord - 1) // 3 + 1 AS ord, " + ", ".join(f"coalesce(max(p_size) FILTER (WHERE (ord - 1) % 3 = {k}), -1)::INTEGER AS c{k + 1}" for k in range(3)) + f" FROM {_GRID} GROUP BY 1")
_nations = lambda s, d: with_ord(_nation(s, d), "n_nationkey").select("ord", F.col("n_regionkey").alias("value"))
_add("fn_wrapcols", lambda s, d: R.wrap_columns(_nations(s, d), 7, pad=-1), "SELECT n_nationkey % 7 + 1 AS ord, " + ", ".join(f"coalesce(max(n_regionkey) FILTER (WHERE n_nationkey // 7 = {k}), -1)::INTEGER AS c{k + 1}" for k in range(4)) + " FROM nation GROUP BY 1")
_add("fn_take", lambda s, d: R.take(_grid(s, d), -25), f"SELECT * FROM {_GRID} WHERE ord > (SELECT count(*) FROM part) - 25")
_add("fn_drop", lambda s, d: R.drop(_grid(s, d), 25), f"SELECT * FROM {_GRID} WHERE ord > 25")
_add("fn_expand", lambda s, d: R.expand(_suppliers(s, d), 2000, {"s_suppkey": -1, "s_name": "none"}), "SELECT range AS ord, CASE WHEN n > 2000 THEN NULL ELSE coalesce(s_suppkey, -1) END AS s_suppkey, CASE WHEN n > 2000 THEN NULL ELSE coalesce(s_name, 'none') END AS s_name, CASE WHEN n > 2000 THEN '#VALUE!' END AS error FROM range(1, 2001) LEFT JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS ord FROM supplier) ON ord = range, (SELECT count(*) AS n FROM supplier) WHERE n <= 2000 OR range = 1")
_add("fn_expand_smaller", lambda s, d: R.expand(_nations(s, d), 20, {}), "SELECT 1::BIGINT AS ord, NULL::INTEGER AS value, '#VALUE!' AS error")
_add("fn_filter_none", lambda s, d: R.or_error(R.filter_rows(_nations(s, d), F.col("value") > 99)), "SELECT 1::BIGINT AS ord, NULL::INTEGER AS value, '#CALC!' AS error")
_add("fn_drop_all", lambda s, d: R.or_error(R.drop(_nations(s, d), 99)), "SELECT 1::BIGINT AS ord, NULL::INTEGER AS value, '#CALC!' AS error")
_add("fn_take_columns", lambda s, d: R.take(_grid(s, d), 40, -2), f"SELECT ord, p_size, p_retailprice FROM {_GRID} WHERE ord <= 40")
_add("fn_choosecols", lambda s, d: R.choose_columns(_grid(s, d), -1, 1, 1), f"SELECT ord, p_retailprice AS c1, p_partkey AS c2, p_partkey AS c3 FROM {_GRID}")
_add("fn_chooserows", lambda s, d: R.choose_rows(_grid(s, d), 5, -1, 2), f"SELECT pos AS ord, p_partkey, p_name, p_size, p_retailprice FROM {_GRID} JOIN (VALUES (1::BIGINT, 5), (2, (SELECT count(*) FROM part)), (3, 2)) t(pos, o) ON ord = o")
_add(
    "fn_randarray",
    lambda s, d: R.random_array(s, 1000, 2, 1.0, 6.0, whole=True, seed=7).select("ord", *[F.col(c).isin(1.0, 2.0, 3.0, 4.0, 5.0, 6.0).alias(c) for c in ("c1", "c2")]),
    "SELECT range AS ord, true AS c1, true AS c2 FROM range(1, 1001)",
)

# lambda forms
_add("fn_makearray", lambda s, d: B.makearray(s, 200, 3, lambda r, c: r * c), "SELECT range AS ord, range::DOUBLE AS c1, range * 2.0::DOUBLE AS c2, range * 3.0::DOUBLE AS c3 FROM range(1, 201)")
_add("fn_map", lambda s, d: B.map_rows(_line(s, d), "value", lambda q, n: q * 2 + n, "l_quantity", "l_linenumber").select("l_orderkey", "value"), "SELECT l_orderkey, l_quantity * 2 + l_linenumber AS value FROM lineitem")
_add(
    "fn_scan",
    lambda s, d: B.scan(_ord(s, d).withColumn("o_totalprice", _exact("o_totalprice")), "o_totalprice", "+", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", F.col("running").cast("double").alias("value")),
    "SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,4)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::DOUBLE AS value FROM orders",
)
_quantities = lambda s, d: _line(s, d).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))), lambda x: x["l_quantity"]).alias("q"))
_add("fn_reduce", lambda s, d: _quantities(s, d).select("l_orderkey", B.reduce_array(F.col("q"), F.lit(0.0), lambda a, v: F.greatest(a, v)).alias("value")), "SELECT l_orderkey, max(l_quantity) AS value FROM lineitem GROUP BY 1")
_add(
    "fn_scan_whole",
    lambda s, d: B.scan(_ord(s, d).withColumn("o_totalprice", _exact("o_totalprice")), "o_totalprice", "+", [], ["o_orderkey"]).select("o_orderkey", F.col("running").cast("double").alias("value")),
    "SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,4)) OVER (ORDER BY o_orderkey)::DOUBLE AS value FROM orders",
)
_add("fn_scan_array", lambda s, d: _quantities(s, d).select("l_orderkey", F.element_at(B.scan_array(F.col("q"), F.lit(0.0), lambda a, v: a + v), -1).alias("value")), "SELECT l_orderkey, sum(l_quantity) AS value FROM lineitem GROUP BY 1")
_add("fn_byrow", lambda s, d: B.byrow(_part(s, d), "value", F.array_max, "p_size", "p_retailprice").select("p_partkey", "value"), "SELECT p_partkey, greatest(p_size, p_retailprice)::DOUBLE AS value FROM part")
_add("fn_bycol", lambda s, d: B.bycol(_part(s, d), A.greatest, "p_size", "p_retailprice"), "SELECT max(p_size)::DOUBLE AS p_size, max(p_retailprice)::DOUBLE AS p_retailprice FROM part")

# cash flows: a customer's orders by key, the first one paid out


def _flows(s: SparkSession, d: str) -> DataFrame:
    orders = _ord(s, d).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderdate"))).alias("o"))
    flow = F.transform("o", lambda x, i: F.when(i == 0, -x["o_totalprice"]).otherwise(x["o_totalprice"]))
    first = F.array_min(F.transform("o", lambda x: x["o_orderdate"]))
    dated = F.transform("o", lambda x, i: F.struct(F.when(i == 0, -x["o_totalprice"]).otherwise(x["o_totalprice"]).alias("value"), F.when(i == 0, 0).otherwise(F.datediff(x["o_orderdate"], first)).cast("double").alias("date")))
    return orders.select("o_custkey", flow.alias("flow"), dated.alias("dated"))


_FLOWS = (
    "(SELECT o_custkey, CASE WHEN k = 1 THEN -o_totalprice ELSE o_totalprice END AS v, k, n, CASE WHEN k = 1 THEN 0 ELSE date_diff('day', d0, o_orderdate::DATE) END AS day FROM "
    "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n, (min(o_orderdate) OVER (PARTITION BY o_custkey))::DATE AS d0 FROM orders))"
)


def _cash(name: str, make: Callable[[], Val], sql: str | None, digits: int = 4) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        v = make()
        return _flows(s, d).select("o_custkey", F.round(v.v, digits).alias("value"), v.error())

    _add(name, run, sql)


def _flow_rows(s: SparkSession, d: str) -> DataFrame:
    """The flows as rows: v, k (from 1) and day (from the earliest order; the first flow is on day 0)."""
    numbered = W.periods(_ord(s, d), ["o_custkey"], ["o_orderkey"], "o_totalprice", "k")
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    return numbered.select("o_custkey", "k", F.when(F.col("k") == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("v"), F.when(F.col("k") == 1, 0).otherwise(F.datediff("o_orderdate", first)).alias("day")).withColumn("year", F.col("day") / 365)


def _sums(name: str, make: Callable[[], Val], sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        v = make()
        return _flow_rows(s, d).groupBy("o_custkey").agg(F.round(v.v, 4).alias("value"), v.error())

    _add(name, run, sql)


_sums("fn_npv", lambda: W.npv(0.05, F.col("v"), F.col("k")), f"SELECT o_custkey, round(sum(v / pow(1.05, k)), 4) AS value, NULL::VARCHAR AS error FROM {_FLOWS} GROUP BY 1")
_sums("fn_xnpv", lambda: W.xnpv(0.05, F.col("v"), F.col("day")), f"SELECT o_custkey, round(sum(v / pow(1.05, day / 365)), 4) AS value, NULL::VARCHAR AS error FROM {_FLOWS} GROUP BY 1")
_sums(
    "fn_mirr",
    lambda: W.mirr(0.05, 0.08, F.col("v"), F.col("k")),
    f"SELECT o_custkey, CASE WHEN any_value(n) > 1 THEN round(pow(-sum(CASE WHEN v > 0 THEN v / pow(1.08, k) ELSE 0 END) * pow(1.08, any_value(n)) / (sum(CASE WHEN v < 0 THEN v / pow(1.05, k) ELSE 0 END) * 1.05), 1.0 / greatest(any_value(n) - 1, 1)) - 1, 4) END AS value, CASE WHEN any_value(n) < 2 THEN '#DIV/0!' END AS error FROM {_FLOWS} GROUP BY 1",
)


def _settled(name: str, make: Callable[[], Val], day: str, found: str) -> None:
    """Whether the rate that was found takes the worth of all flows to nothing, measured against their sizes."""

    def run(s: SparkSession, d: str) -> DataFrame:
        v = make()
        rated = _flows(s, d).select("o_custkey", v.v.alias("rate"), v.error())
        both = _flow_rows(s, d).join(rated, "o_custkey")
        worth, size = F.col("v") * F.pow(1 + F.col("rate"), -F.col(day)), F.abs("v") * F.pow(1 + F.col("rate"), -F.col(day))
        return both.withColumn("worth", worth).withColumn("size", size).groupBy("o_custkey").agg((F.abs(F.sum("worth")) <= 1e-6 * F.sum("size")).alias("settled"), F.max("error").alias("error"))

    _add(name, run, found)


# SQL solves no rate, but says which flows have one: those of both signs, and for XIRR a worth that
# changes its sign between the least and the largest rate that is tried
_settled("fn_irr", lambda: M.irr(F.col("flow")), "k", f"SELECT o_custkey, CASE WHEN any_value(n) > 1 THEN true END AS settled, CASE WHEN any_value(n) = 1 THEN '#NUM!' END AS error FROM {_FLOWS} GROUP BY 1")
_HAS_RATE = "sum(v * pow(1e12 + 1, -day / 365.0)) < 0 AND sum(v * pow(1e-6, -day / 365.0)) > 0"
_settled("fn_xirr", lambda: M.xirr(F.col("dated")), "year", f"SELECT o_custkey, CASE WHEN {_HAS_RATE} THEN true END AS settled, CASE WHEN NOT ({_HAS_RATE}) THEN '#NUM!' END AS error FROM {_FLOWS} GROUP BY 1")


def queries() -> dict[str, Run]:
    return {name: run for name, (run, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TABLE.items() if sql}
