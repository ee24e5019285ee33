"""Lookups as joins. ``table_ord`` is the position of a row in the lookup table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import wildcard_regex
from tabulon.functions.values import NA, REF, VALUE, fold
from tabulon.operators.ordering import before_parts, in_order


def _folded(c: Column, is_text: bool) -> Column:
    return fold(c) if is_text else c


def _is_text(frame: DataFrame, column: str) -> bool:
    return dict(frame.dtypes)[column] == "string"


def lookup_exact(
    frame: DataFrame, key: str, table: DataFrame, table_key: str, returns: str, table_ord: str, *, out: str = "found", last: bool = False, if_missing: object = None
) -> DataFrame:
    """VLOOKUP/XLOOKUP/MATCH exact: the first (or last) row with the key; text without case.

    The table is cut to one row a key before the join; whether it is then broadcast is left to
    the optimizer's measure of its size.
    """
    is_text = _is_text(table, table_key)
    pick = F.max_by if last else F.min_by
    one = table.where(F.col(table_key).isNotNull()).groupBy(_folded(F.col(table_key), is_text).alias("_k")).agg(pick(returns, table_ord).alias(out), F.lit(True).alias("_hit"))
    joined = frame.join(one, _folded(F.col(key), is_text) == F.col("_k"), "left").drop("_k")
    value = F.col(out) if if_missing is None else F.when(F.col("_hit"), F.col(out)).otherwise(F.lit(if_missing))
    return joined.withColumn(out, value).withColumn("error", F.when(F.col("_hit").isNull() & F.lit(if_missing is None), F.lit(NA))).drop("_hit")


def lookup_nearest(
    frame: DataFrame, key: str, table: DataFrame, table_key: str, returns: str, table_ord: str | None = None, *, out: str = "found", larger: bool = False, exact_first: bool = False
) -> DataFrame:
    """Approximate VLOOKUP, MATCH 1 and XLOOKUP -1 (or 1 with ``larger``): the nearest key.

    Of equal table keys the last row by ``table_ord`` counts, as it does for VLOOKUP on sorted
    keys; the first with ``exact_first``, as for XLOOKUP. Keys are numbers of any type, or text
    without case. Each distinct key is looked up once: table keys and wanted keys are sorted
    together over ranges, a pass within each range carries the last table row on, and a range
    starts from the last table row of the ranges before it. So equal wanted keys meet nowhere but
    in the join that brings their rows back, which can be split, and null keys take no part.
    """
    is_text = _is_text(table, table_key)
    turned = (lambda c: c.desc()) if larger else (lambda c: c.asc())
    position = F.col(table_ord) if table_ord else F.lit(0)
    pick = F.min_by if exact_first else F.max_by
    rows = table.where(F.col(table_key).isNotNull()).groupBy(_folded(F.col(table_key), is_text).alias("_k"))
    rows = rows.agg(pick(F.struct(F.col(returns).alias("v")), position).alias("_v"))
    wanted = frame.where(F.col(key).isNotNull()).select(_folded(F.col(key), is_text).alias("_k")).distinct()
    both = rows.withColumn("_side", F.lit(0)).unionByName(wanted.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    placed = in_order(both, turned(F.col("_k")), "_side")
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.where("_side = 0").groupBy("_part").agg(F.max_by("_v", "_place").alias("_end"))
    every = placed.select("_part").distinct().join(ends, "_part", "left")
    start = before_parts(every, F.last("_end", ignorenulls=True), "_start")
    seen = placed.withColumn("_seen", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    found = seen.join(F.broadcast(start), "_part", "left").select("_k", F.coalesce("_seen", "_start").alias("_got"))
    joined = frame.join(found, _folded(F.col(key), is_text) == F.col("_k"), "left")
    return joined.withColumn(out, F.col("_got.v")).withColumn("error", F.when(F.col("_got").isNull(), F.lit(NA))).drop("_k", "_got")


def lookup_wildcard(frame: DataFrame, key: str, table: DataFrame, table_key: str, returns: str, table_ord: str, *, out: str = "found", last: bool = False) -> DataFrame:
    """XLOOKUP mode 2 and exact look-ups of texts with * ? ~: the first (or last) row that a pattern matches.

    Keys without such a mark are plain ones, and meet the table in an exact look-up. Patterns
    have no key to meet by: each distinct one is held against each row of the table, and only its
    best row is kept. They are what a formula's author writes, so there are few of them; whether they
    are broadcast is left to Spark's measure of their size.
    """
    marked = F.col(key).rlike(r"[*?~]")
    plain = lookup_exact(frame.where(~F.coalesce(marked, F.lit(False))), key, table, table_key, returns, table_ord, out=out, last=last)
    frame = frame.where(marked)
    patterns = frame.select(F.col(key).alias("_p")).distinct()
    escaped = F.regexp_replace("_p", r"([\\.\[\]{}()+\-^$|])", r"\\$1")
    held = F.replace(F.replace(F.replace(escaped, F.lit("~~"), F.lit("\x01")), F.lit("~*"), F.lit("\x02")), F.lit("~?"), F.lit("\x03"))
    wild = F.replace(F.replace(held, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*"))
    regex = F.concat(F.lit("(?is)^"), F.replace(F.replace(F.replace(wild, F.lit("\x01"), F.lit("~")), F.lit("\x02"), F.lit("\\*")), F.lit("\x03"), F.lit("\\?")), F.lit("$"))
    pick = F.max_by if last else F.min_by
    rows = table.where(F.col(table_key).isNotNull()).select(F.col(table_key).alias("_t"), F.struct(F.col(returns).alias("v")).alias("_v"), F.col(table_ord).alias("_o"))
    hits = rows.join(patterns.withColumn("_r", regex), F.rlike("_t", F.col("_r"))).groupBy("_p").agg(pick("_v", "_o").alias("_got"))
    joined = frame.join(hits, F.col(key) == F.col("_p"), "left")
    wild_ = joined.withColumn(out, F.col("_got.v")).withColumn("error", F.when(F.col("_got").isNull(), F.lit(NA))).drop("_p", "_got")
    return wild_.unionByName(plain)


def match_wildcard(table: DataFrame, column: str, pattern: str, table_ord: str) -> DataFrame:
    """MATCH 0 with * ? ~: the position of the first row whose text matches."""
    hit = F.col(column).rlike("(?is)^" + wildcard_regex(pattern) + "$")
    return table.where(hit).agg(F.min(table_ord).alias("value")).withColumn("error", F.when(F.col("value").isNull(), F.lit(NA)))


def match_place(table: DataFrame, column: str, key: object, table_ord: str, kind: int) -> DataFrame:
    """MATCH 1 (the last place whose key is not above, keys sorted) and -1 (the first place whose key is not below)."""
    c = _folded(F.col(column), _is_text(table, column))
    wanted = key.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if isinstance(key, str) else key
    found = F.max(table_ord) if kind > 0 else F.min(table_ord)
    return table.where(c <= wanted if kind > 0 else c >= wanted).agg(found.alias("value")).withColumn("error", F.when(F.col("value").isNull(), F.lit(NA)))


def index_row(table: DataFrame, table_ord: str, row: int, column: str) -> DataFrame:
    """INDEX: one cell by position, #REF! where there is none."""
    cell = table.where(F.col(table_ord) == row).agg(F.first(column).alias("value"), F.count("*").alias("_n"))
    return cell.withColumn("error", F.when(F.col("_n") == 0, F.lit(REF))).drop("_n")


def hlookup(frame: DataFrame, key: str, table: DataFrame, table_ord: str, row: int, *, out: str = "found") -> DataFrame:
    """HLOOKUP exact: the column of ``table`` whose cell in row 1 is the key, and its cell in row ``row``.

    The two rows are picked by position and turned to (head, value) pairs, one a column.
    """
    cells = [c for c in table.columns if c != table_ord]
    two = table.where(F.col(table_ord).isin(1, row)).select(table_ord, F.posexplode(F.array(*[F.col(c).cast("string") for c in cells])).alias("_c", "_v"))
    pairs = two.groupBy("_c").agg(F.max(F.when(F.col(table_ord) == 1, F.col("_v"))).alias("_head"), F.max(F.when(F.col(table_ord) == row, F.col("_v"))).alias("_value"), F.max(table_ord).alias("_last"))
    found = lookup_exact(frame, key, pairs, "_head", "_value", "_c", out=out)
    if row < 1:
        return found.withColumn(out, F.lit(None).cast("string")).withColumn("error", F.lit(VALUE))
    height = table.agg(F.max(table_ord).alias("_height"))
    return found.join(F.broadcast(height)).withColumn("error", F.when(F.coalesce("_height", F.lit(0)) < row, F.lit(REF)).otherwise(F.col("error"))).drop("_height")
