"""Dynamic arrays as DataFrames with an explicit position ``ord``; cells of a grid are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.values import CALC, NA, VALUE, fold, r15


class CellError(ValueError):
    """A function whose arguments alone make it an error; its text is the code."""


def or_error(frame: DataFrame, code: str = CALC) -> DataFrame:
    """The frame with a column ``error``; where it has no row, one row that says so."""
    cells = [F.col(c) for c in frame.columns]
    shown = frame.select(*cells, F.lit(None).cast("string").alias("error"))
    blank = [F.lit(None).cast(t).alias(c) if c != "ord" else F.lit(1).cast("long").alias("ord") for c, t in frame.dtypes]
    none = frame.limit(1).agg(F.count("*").alias("_n")).where("_n = 0").select(*blank, F.lit(code).alias("error"))
    return shown.unionByName(none)


def filter_rows(frame: DataFrame, include: Column) -> DataFrame:
    """FILTER by a condition on each row; ``or_error`` says #CALC! where none is left."""
    return frame.where(include)


def filter_columns(frame: DataFrame, *include: bool) -> DataFrame:
    """FILTER by a row of logicals, one a column."""
    cells = [c for c in frame.columns if c != "ord"]
    if len(include) != len(cells):
        raise CellError(VALUE)
    if not any(include):
        raise CellError(CALC)
    return frame.select("ord", *[c for c, keep in zip(cells, include, strict=True) if keep])


def sort_keys(column: str, kind: str, order: int = 1) -> list[Column]:
    """Blanks last either way; text without case."""
    c = F.col(column)
    value = fold(c) if kind == "text" else r15(c) if kind == "double" else c
    return [c.isNull().asc(), value.asc() if order == 1 else value.desc()]


def sort_rows(frame: DataFrame, column: str, order: int = 1, *, kind: str = "number") -> DataFrame:
    """SORT, stable by ``ord``."""
    return frame.orderBy(*sort_keys(column, kind, order), "ord")


def sort_by(frame: DataFrame, *by: tuple[str, str, int]) -> DataFrame:
    """SORTBY: (column, kind, order) keys in turn, then ``ord``."""
    return frame.orderBy(*[k for column, kind, order in by for k in sort_keys(column, kind, order)], "ord")


def unique_rows(frame: DataFrame, columns: list[str], *, once: bool = False) -> DataFrame:
    """UNIQUE rows at their first position; with ``once`` those that occur exactly once."""
    kinds = dict(frame.dtypes)
    keys = [(fold(F.col(c)) if kinds[c] == "string" else r15(F.col(c)) if kinds[c] == "double" else F.col(c)).alias(f"_k{i}") for i, c in enumerate(columns)]
    firsts = [F.min_by(c, "ord").alias(c) for c in columns]
    out = frame.groupBy(*keys).agg(F.min("ord").alias("ord"), F.count("*").alias("_n"), *firsts)
    return (out.where("_n = 1") if once else out).select("ord", *columns)


def to_column(frame: DataFrame, columns: list[str], *, skip_blanks: bool = False, by_column: bool = False) -> DataFrame:
    """TOCOL: (ord, value) row by row, or column by column."""
    width = len(columns)
    cells = frame.select("ord", F.posexplode(F.array(*[F.col(c) for c in columns])).alias("_p", "value"))
    place = [F.col("_p"), F.col("ord")] if by_column else [((F.col("ord") - 1) * width + F.col("_p") + 1)]
    out = cells.where(F.col("value").isNotNull()) if skip_blanks else cells
    if not by_column:
        return out.select(place[0].alias("ord"), "value")
    height = frame.agg(F.max("ord").alias("_height"))
    return out.join(F.broadcast(height)).select((F.col("_p") * F.col("_height") + F.col("ord")).alias("ord"), "value")


def to_row(frame: DataFrame, columns: list[str], by: list[str] | None = None, **options: bool) -> DataFrame:
    """TOROW: one row a ``by`` group with the cells as an array in TOCOL order.

    A row of a sheet has at most 16,384 cells; a group is meant to be of that size.
    """
    width = len(columns)
    cells = frame.select("ord", *(by or []), F.posexplode(F.array(*[F.col(c) for c in columns])).alias("_p", "value"))
    cells = cells.where(F.col("value").isNotNull()) if options.get("skip_blanks") else cells
    at = F.struct("_p", "ord") if options.get("by_column") else F.struct((F.col("ord") - 1) * width + F.col("_p"))
    listed = F.sort_array(F.collect_list(F.struct(at.alias("at"), "value")))
    return cells.groupBy(*(by or [])).agg(F.transform(listed, lambda x: x["value"]).alias("cells"))


def sequence(spark: SparkSession, rows: int, columns: int = 1, start: float = 1.0, step: float = 1.0) -> DataFrame:
    cells = [(F.lit(start) + (F.col("id") * columns + k) * step).alias(f"c{k + 1}") for k in range(columns)]
    return spark.range(rows).select((F.col("id") + 1).alias("ord"), *cells)


def vstack(*frames: DataFrame) -> DataFrame:
    """VSTACK by column position; (src, ord) is the order.

    A column that a frame does not have is null there, with #N/A in the column's ``_error``;
    columns that all frames have carry no such column.
    """
    width = max(len(f.columns) - 1 for f in frames)
    least = min(len(f.columns) - 1 for f in frames)
    out = None
    for k, f in enumerate(frames):
        cells = [c for c in f.columns if c != "ord"]
        padded = [(F.lit(None).cast("string") if i < len(cells) else F.lit(NA)).alias(f"c{i + 1}_error") for i in range(least, width)]
        one = f.select(F.lit(k).alias("src"), "ord", *[F.col(c).alias(f"c{i + 1}") for i, c in enumerate(cells)], *padded)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("src", "ord", *[f"c{i + 1}" for i in range(width)], *[f"c{i + 1}_error" for i in range(least, width)])


def hstack(*frames: DataFrame) -> DataFrame:
    """HSTACK on position; rows that a frame does not have are null, and #N/A in its column ``_error<k>``."""
    out = None
    for k, f in enumerate(frames):
        one = f.withColumn(f"_here{k}", F.lit(True))
        out = one if out is None else out.join(one, "ord", "full")
    for k in range(len(frames)):
        out = out.withColumn(f"_error{k}", F.when(F.col(f"_here{k}").isNull(), F.lit(NA))).drop(f"_here{k}")
    return out


def wrap_rows(vector: DataFrame, width: int, pad: object = None) -> DataFrame:
    """WRAPROWS: a vector (ord, value) into rows of ``width``."""
    if width < 1:
        raise CellError("#NUM!")
    at = F.col("ord") - 1
    row, place = F.floor(at / width), (at % width).cast("int")
    cells = [F.coalesce(F.max(F.when(F.col("_p") == k, F.col("value"))), F.lit(pad)).alias(f"c{k + 1}") for k in range(width)]
    return vector.select((row + 1).alias("ord"), place.alias("_p"), "value").groupBy("ord").agg(*cells)


def wrap_columns(vector: DataFrame, height: int, columns: int | None = None, pad: object = None) -> DataFrame:
    """WRAPCOLS: a vector into columns of ``height``; how many that makes is counted unless it is given."""
    if height < 1:
        raise CellError("#NUM!")
    columns = columns or max(1, -(-vector.count() // height))
    at = F.col("ord") - 1
    cells = [F.coalesce(F.max(F.when(F.col("_p") == k, F.col("value"))), F.lit(pad)).alias(f"c{k + 1}") for k in range(columns)]
    return vector.select((at % height + 1).alias("ord"), F.floor(at / height).cast("int").alias("_p"), "value").groupBy("ord").agg(*cells)


def _some_columns(frame: DataFrame, columns: int | None, taken: bool) -> DataFrame:
    """The first (or with a negative number last) columns, or all but those."""
    if columns is None:
        return frame
    cells = [c for c in frame.columns if c != "ord"]
    if taken:
        kept = cells[:columns] if columns >= 0 else cells[columns:]
    else:
        kept = cells[columns:] if columns >= 0 else cells[:columns]
    if not kept:
        raise CellError(CALC)
    return frame.select("ord", *kept)


def take(frame: DataFrame, rows: int, columns: int | None = None) -> DataFrame:
    """TAKE from the start, or with a negative number from the end; 0 is #CALC!."""
    if rows == 0 or columns == 0:
        raise CellError(CALC)
    frame = _some_columns(frame, columns, True)
    if rows >= 0:
        return frame.where(F.col("ord") <= rows)
    last = frame.agg(F.max("ord").alias("_last"))
    return frame.join(F.broadcast(last), F.col("ord") > F.col("_last") + rows).drop("_last")


def drop(frame: DataFrame, rows: int, columns: int | None = None) -> DataFrame:
    """DROP from the start, or with a negative number from the end; ``or_error`` says #CALC! where nothing is left."""
    frame = _some_columns(frame, columns, False)
    if rows >= 0:
        return frame.where(F.col("ord") > rows)
    last = frame.agg(F.max("ord").alias("_last"))
    return frame.join(F.broadcast(last), F.col("ord") <= F.col("_last") + rows).drop("_last")


def expand(frame: DataFrame, rows: int, pad: dict[str, object]) -> DataFrame:
    """EXPAND to so many rows, new cells padded; fewer rows than there are is one row with #VALUE!."""
    names = [c for c in frame.columns if c != "ord"]
    height = frame.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("_height"))
    base = frame.sparkSession.range(1, rows + 1).select(F.col("id").alias("ord"))
    marked = frame.withColumn("_has", F.lit(True))
    out = base.join(marked, "ord", "left").join(F.broadcast(height))
    small = F.col("_height") > rows
    cells = [F.when(small, None).when(F.col("_has"), F.col(c)).otherwise(F.lit(pad.get(c))).alias(c) for c in names]
    return out.where(~small | (F.col("ord") == 1)).select("ord", *cells, F.when(small, F.lit(VALUE)).alias("error"))


def choose_columns(frame: DataFrame, *which: int) -> DataFrame:
    """CHOOSECOLS: 1-based, negative from the right, repeats allowed."""
    cells = [c for c in frame.columns if c != "ord"]
    if any(i == 0 or abs(i) > len(cells) for i in which):
        raise CellError(VALUE)
    return frame.select("ord", *[F.col(cells[i - 1 if i > 0 else i]).alias(f"c{k + 1}") for k, i in enumerate(which)])


def choose_rows(frame: DataFrame, *which: int) -> DataFrame:
    """CHOOSEROWS: 1-based, negative from the end; the result is numbered in the order asked."""
    spark = frame.sparkSession
    wanted = spark.createDataFrame([(k + 1, i) for k, i in enumerate(which)], "pos long, want long")
    last = frame.agg(F.max("ord").alias("_last"))
    wanted = wanted.join(F.broadcast(last)).select("pos", F.when(F.col("want") > 0, F.col("want")).otherwise(F.col("_last") + F.col("want") + 1).alias("_ord"))
    return frame.join(F.broadcast(wanted), F.col("ord") == F.col("_ord")).drop("ord", "_ord").withColumnRenamed("pos", "ord")


def random_array(spark: SparkSession, rows: int, columns: int = 1, low: float = 0.0, high: float = 1.0, *, whole: bool = False, seed: int = 0) -> DataFrame:
    """RANDARRAY: whole numbers include both ends, decimals the lower one."""
    if rows < 1 or columns < 1:
        raise CellError(CALC)
    if low > high or whole and (low != int(low) or high != int(high)):
        raise CellError(VALUE)

    def cell(k: int) -> Column:
        u = F.rand(seed + k)
        return F.floor(F.lit(low) + u * (high - low + 1)).cast("double") if whole else F.lit(low) + u * (high - low)

    return spark.range(rows).select((F.col("id") + 1).alias("ord"), *[cell(k).alias(f"c{k + 1}") for k in range(columns)])
