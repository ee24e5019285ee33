"""Formulas over whole tables: aggregates, criteria, look-ups, reshaping and LAMBDA forms as DataFrames.

``table_formula({"part": parts}, "=TAKE(SORT(FILTER(part,part.p_size>40),3,-1),10)")`` gives a
DataFrame. A table is a DataFrame with a position column ``ord``; ``part`` is all its cells and
``part.p_size`` one column. Operators work cell by cell on columns, aggregates run once over
their table and join back as one row, look-ups become joins, and array functions the operators
of ``tabulon.operators``. Results have ``ord`` where they have rows in order, cells ``c1``,
``c2`` and so on or one ``value``, and an ``error`` code where a cell can have one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tabulon.functions.logic as L
import tabulon.operators.aggregate as A
import tabulon.operators.criteria as C
import tabulon.operators.lambdas as B
import tabulon.operators.lookup as K
import tabulon.operators.reshape as R
from tabulon.functions.values import DIV0, VALUE, Val, as_val, boolean, first_error, number, roomy, serial, text
from tabulon.operators.ordering import with_ord
from tabulon.plans.formula import CALLS, Lambda, lower, lower_value
from tabulon.plans.parser import FormulaError, Node, parse

ORD = "ord"


@dataclass
class Grid:
    """Rows in order, and the names of their cells."""

    frame: DataFrame
    cells: list[str]

    def named(self) -> DataFrame:
        """ord and cells c1, c2, ...; other columns, such as error codes, as they are."""
        rest = [c for c in self.frame.columns if c != ORD and c not in self.cells]
        shown = [F.col(c).alias(f"c{k + 1}") for k, c in enumerate(self.cells)]
        return self.frame.select(ORD, *shown, *rest)


@dataclass(frozen=True)
class Line:
    """What BYROW binds: the cells of one row."""

    cells: tuple[Val, ...]


def typed(column: str, kind: str) -> Val:
    """A column as worksheet values: numbers, text, logicals, dates as serial numbers."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return serial(column)
    return text(column) if kind == "string" else boolean(column) if kind == "boolean" else number(column)


def literal(node: Node) -> object:
    """A number, text or logical that is written out."""
    if node.kind == "sign":
        n = float(literal(node.parts[0]))
        return -n if node.value == "-" else n
    if node.kind in ("number", "text"):
        return node.value
    if node.kind == "name" and str(node.value).lower() in ("true", "false"):
        return str(node.value).lower() == "true"
    raise FormulaError("a number, text or logical has to be written here")


def _int(nodes: list[Node], k: int, default: int | None) -> int | None:
    return int(literal(nodes[k])) if len(nodes) > k and nodes[k].kind != "missing" else default


def _numbers(v: Val) -> Column:
    """Only numbers of a range count."""
    return v.v if v.kind == "number" else F.lit(None).cast("double")


def _sum(parts: list[Val]) -> Val:
    return Val("number", functools.reduce(lambda a, b: a + b, [A.total(_numbers(v)) for v in parts]))


def _average(parts: list[Val]) -> Val:
    n = functools.reduce(lambda a, b: a + b, [A.count_numbers(_numbers(v)) for v in parts])
    return Val("number", F.try_divide(_sum(parts).v, n), F.when(n == 0, F.lit(DIV0)))


def _extreme(parts: list[Val], one: Callable[[Column], Column], both: Callable[..., Column]) -> Val:
    found = [one(_numbers(v)) for v in parts]
    return Val("number", F.coalesce(found[0] if len(found) == 1 else both(*found), F.lit(0.0)))


def _count(parts: list[Val], one: Callable[[Val], Column]) -> Val:
    return Val("number", functools.reduce(lambda a, b: a + b, [one(v) for v in parts]).cast("double"))


def _product(parts: list[Val]) -> Val:
    any_ = functools.reduce(lambda a, b: a + b, [A.count_numbers(_numbers(v)) for v in parts])
    all_ = functools.reduce(lambda a, b: a * b, [F.coalesce(F.product(_numbers(v)), F.lit(1.0)) for v in parts])
    return Val("number", F.when(any_ == 0, 0.0).otherwise(all_))


def _logical(parts: list[Val], fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Val:
    bad = first_error(*[F.when(F.count(v.v) > 0, F.lit(VALUE)) for v in parts if v.kind == "text"])
    known = [fold(v.v.cast("double")) for v in parts if v.kind != "text"] or [F.lit(True)]
    return Val("bool", functools.reduce(join, known), bad)


#: Aggregates of columns, each a function of the columns' values.
AGGREGATES: dict[str, Callable[[list[Val]], Val]] = {
    "SUM": _sum,
    "PRODUCT": _product,
    "AVERAGE": _average,
    "MIN": lambda parts: _extreme(parts, F.min, F.least),
    "MAX": lambda parts: _extreme(parts, F.max, F.greatest),
    "COUNT": lambda parts: _count(parts, lambda v: F.count(_numbers(v))),
    "COUNTA": lambda parts: _count(parts, lambda v: A.count_filled(v.v)),
    "COUNTBLANK": lambda parts: _count(parts, lambda v: A.count_blank(v.v)),
    "SUMPRODUCT": lambda parts: Val("number", A.sumproduct(*[v.v if v.kind == "number" else F.lit(0.0) for v in parts])),
    "AND": lambda parts: _logical(parts, A.all_true, lambda a, b: a & b),
    "OR": lambda parts: _logical(parts, A.any_true, lambda a, b: a | b),
    "XOR": lambda parts: _logical(parts, A.odd_true, lambda a, b: a != b),
}

#: The same over the cells of one row.
_IN_ROW: dict[str, Callable[[Column], Column]] = {
    "SUM": lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y),
    "PRODUCT": lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(a, F.lit(1.0), lambda x, y: x * y)),
    "AVERAGE": lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a)),
    "MIN": lambda a: F.coalesce(F.array_min(a), F.lit(0.0)),
    "MAX": lambda a: F.coalesce(F.array_max(a), F.lit(0.0)),
    "COUNT": lambda a: F.size(a).cast("double"),
}


class Compiler:
    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = {}
        for name, frame in tables.items():
            if ORD not in frame.columns:
                raise FormulaError(f"{name} has no column {ORD}: number its rows with with_ord")
            self.tables[name.lower()] = frame
        self.spark = next(iter(tables.values())).sparkSession if tables else SparkSession.builder.getOrCreate()
        self.scope: dict[str, object] = {CALLS: self.call}
        for name, frame in self.tables.items():
            for column, kind in frame.dtypes:
                self.scope[f"{name}.{column}".lower()] = typed(f"{name}__{column}", kind)
        self.made: dict[str, list[tuple[str, Val]]] = {}

    # columns and tables

    def frame(self, table: str) -> DataFrame:
        """A table with its columns under names of its own."""
        f = self.tables[table]
        return f.select(*[F.col(c).alias(f"{table}__{c}") for c in f.columns])

    def used(self, node: Node, scope: dict[str, object] | None = None, aggregates: bool = False) -> set[str]:
        """Tables whose columns a node uses row by row; with ``aggregates`` inside aggregates too."""
        if node.kind == "name":
            table, _, column = str(node.value).lower().partition(".")
            return {table} if column and table in self.tables else set()
        if node.kind == "call" and not aggregates and self.aggregates(node):
            return set()
        return set().union(*[self.used(p, scope, aggregates) for p in node.parts]) if node.parts else set()

    def aggregates(self, node: Node) -> bool:
        """Whether a call folds whole columns."""
        name = str(node.value)
        return (name in AGGREGATES or name in CRITERIA) and any(self.used(p, aggregates=True) for p in node.parts)

    def call(self, name: str, args: list[Node], scope: dict[str, object]) -> object:
        """Aggregates met while a formula is lowered: made once, and referred to by name."""
        bound = [scope.get(str(a.value).lower()) if a.kind == "name" else None for a in args]
        if name in _IN_ROW and any(isinstance(b, Line) for b in bound):
            cells = [c for b in bound if isinstance(b, Line) for c in b.cells]
            numbers = F.array_compact(F.array(*[_numbers(c) for c in cells]))
            value = _IN_ROW[name](numbers)
            return Val("number", value, F.when(F.size(numbers) == 0, F.lit(DIV0)) if name == "AVERAGE" else None)
        if not self.aggregates(Node("call", name, args)):
            return NotImplemented
        tables = set().union(*[self.used(a, aggregates=True) for a in args])
        if len(tables) > 1:
            raise FormulaError(f"{name} takes columns of one table")
        table = tables.pop()
        if name in CRITERIA:
            found = CRITERIA[name](self, args, scope)
        else:
            constant = [a for a in args if not self.used(a, aggregates=True)]
            found = AGGREGATES[name]([as_val(lower_value(a, scope)) for a in args if a not in constant])
            if constant and name == "SUM":
                found = L.add(found, functools.reduce(L.add, [lower_value(a, scope) for a in constant]))
            elif constant:
                raise FormulaError(f"{name} takes columns")
        held = self.made.setdefault(table, [])
        alias = f"_agg_{table}_{len(held)}"
        held.append((alias, found))
        return Val(found.kind, F.col(alias), None if found.e is None else F.col(alias + "_error"))

    def joined(self, base: DataFrame) -> DataFrame:
        """base with the aggregates made so far, one row a table."""
        for table, held in self.made.items():
            one = self.frame(table).agg(*[c for alias, v in held for c in (v.v.alias(alias), v.error(alias + "_error"))])
            base = base.join(F.broadcast(one))
        return base

    def values(self, node: Node) -> DataFrame:
        """A formula of columns, row by row, or of aggregates, as one row."""
        rows = self.used(node)
        if len(rows) > 1:
            raise FormulaError("columns of several tables meet by a look-up only")
        self.made = {}
        v = as_val(lower_value(node, self.scope))
        if rows:
            table = rows.pop()
            return self.joined(self.frame(table)).select(F.col(f"{table}__{ORD}").alias(ORD), v.v.alias("value"), v.error())
        return self.joined(self.spark.range(1)).select(v.v.alias("value"), v.error())

    # arrays

    def is_grid(self, node: Node) -> bool:
        if node.kind == "name":
            table, _, column = str(node.value).lower().partition(".")
            return table in self.tables and (not column or f"{table}.{column}" in self.scope)
        return node.kind == "array" or node.kind == "call" and str(node.value) in GRIDS

    def grid(self, node: Node) -> Grid:
        if node.kind == "name":
            table, _, column = str(node.value).lower().partition(".")
            if table in self.tables:
                frame = self.tables[table]
                names = {c.lower(): c for c in frame.columns}
                cells = [names[column]] if column else [c for c in frame.columns if c != ORD]
                return Grid(frame.select(ORD, *cells), cells)
        if node.kind == "array":
            rows = [[literal(c) for c in row.parts] for row in node.parts]
            cells = [f"c{k + 1}" for k in range(len(rows[0]))]
            return Grid(self.spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], [ORD, *cells]), cells)
        if node.kind == "call" and str(node.value) in GRIDS:
            return GRIDS[str(node.value)](self, node.parts)
        if self.used(node):
            frame = self.values(node)
            return Grid(frame, ["value"])
        raise FormulaError("a table, a column or an array is missing")

    def vector(self, node: Node) -> tuple[DataFrame, str]:
        g = self.grid(node)
        if len(g.cells) != 1:
            raise FormulaError("one column is wanted")
        return g.frame, g.cells[0]

    def run(self, formula: str) -> DataFrame:
        node = parse(formula)
        if self.is_grid(node):
            return self.grid(node).named()
        if node.kind == "call" and str(node.value) in ROWS:
            return ROWS[str(node.value)](self, node.parts)
        return self.values(node)


# ---------------------------------------------------------------- criteria


def _tests(compiler: Compiler, pairs: list[Node], scope: dict[str, object], counting: bool) -> list[Column]:
    out = []
    for column, wanted in zip(pairs[::2], pairs[1::2], strict=True):
        v = as_val(lower_value(column, scope))
        out.append(C.criterion(v.v, v.kind, literal(wanted), counting=counting))
    return out


def _one(make: Callable[[Column, list[Column]], Val]) -> Callable:
    def run(compiler: Compiler, args: list[Node], scope: dict[str, object]) -> Val:
        value = as_val(lower_value(args[2] if len(args) > 2 else args[0], scope))
        return make(_numbers(value), _tests(compiler, args[:2], scope, False))

    return run


def _many(make: Callable[[Column, list[Column]], Val]) -> Callable:
    def run(compiler: Compiler, args: list[Node], scope: dict[str, object]) -> Val:
        return make(_numbers(as_val(lower_value(args[0], scope))), _tests(compiler, args[1:], scope, False))

    return run


_sum_where = lambda v, tests: Val("number", C.sumifs(v, *tests))
_average_where = lambda v, tests: C.averageifs(v, *tests)
_count_where = lambda compiler, args, scope: Val("number", C.countifs(*_tests(compiler, args, scope, True)).cast("double"))

CRITERIA: dict[str, Callable[[Compiler, list[Node], dict[str, object]], Val]] = {
    "SUMIF": _one(_sum_where), "SUMIFS": _many(_sum_where), "AVERAGEIF": _one(_average_where), "AVERAGEIFS": _many(_average_where), "COUNTIF": _count_where, "COUNTIFS": _count_where,
}


# ---------------------------------------------------------------- arrays


def _kind(frame: DataFrame, column: str) -> str:
    kind = dict(frame.dtypes)[column]
    return "text" if kind == "string" else kind


def _filter(compiler: Compiler, args: list[Node]) -> Grid:
    g = compiler.grid(args[0])
    if args[1].kind == "array":
        kept = R.filter_columns(g.frame.select(ORD, *g.cells), *[bool(literal(c)) for c in args[1].parts[0].parts])
        return Grid(kept, [c for c in kept.columns if c != ORD])
    tables = compiler.used(args[1])
    if len(tables) != 1:
        raise FormulaError("FILTER wants a condition on the columns of its table")
    table = tables.pop()
    compiler.made = {}
    test = L.truth(lower_value(args[1], compiler.scope))
    keep = compiler.joined(compiler.frame(table)).where(test.v if test.e is None else test.e.isNull() & test.v).select(F.col(f"{table}__{ORD}").alias(ORD))
    return Grid(g.frame.join(keep, ORD, "left_semi"), g.cells)


def _sorted(g: Grid, *keys: Column) -> Grid:
    numbered = with_ord(g.frame.withColumnRenamed(ORD, "_was"), *keys, "_was").drop("_was")
    return Grid(numbered, g.cells)


def _renumbered(g: Grid) -> Grid:
    return _sorted(g)


def _sort(compiler: Compiler, args: list[Node]) -> Grid:
    g = compiler.grid(args[0])
    at, order = _int(args, 1, 1), _int(args, 2, 1)
    if not 1 <= at <= len(g.cells) or order not in (1, -1):
        raise R.CellError(VALUE)
    return _sorted(g, *R.sort_keys(g.cells[at - 1], _kind(g.frame, g.cells[at - 1]), order))


def _sortby(compiler: Compiler, args: list[Node]) -> Grid:
    g = compiler.grid(args[0])
    keys: list[Column] = []
    frame = g.frame
    for k in range(1, len(args), 2):
        by, column = compiler.vector(args[k])
        name = f"_by{k}"
        frame = frame.join(by.select(ORD, F.col(column).alias(name)), ORD)
        keys += R.sort_keys(name, _kind(by, column), _int(args, k + 1, 1))
    out = _sorted(Grid(frame, g.cells), *keys)
    return Grid(out.frame.select(ORD, *g.cells), g.cells)


def _unique(compiler: Compiler, args: list[Node]) -> Grid:
    g = compiler.grid(args[0])
    if len(args) > 1 and args[1].kind != "missing" and literal(args[1]):
        raise FormulaError("UNIQUE of columns is for arrays, not for tables")
    return _renumbered(Grid(R.unique_rows(g.frame, g.cells, once=len(args) > 2 and bool(literal(args[2]))), g.cells))


def _take(compiler: Compiler, args: list[Node], taken: bool) -> Grid:
    g = compiler.grid(args[0])
    frame = g.frame.select(ORD, *g.cells)
    rows, columns = _int(args, 1, None), _int(args, 2, None)
    if taken:
        frame = R.take(frame, (1 << 31) if rows is None else rows, columns)
    else:
        frame = R.drop(frame, rows or 0, columns)
    return _renumbered(Grid(frame, [c for c in frame.columns if c != ORD]))


def _chosen(compiler: Compiler, args: list[Node], rows: bool) -> Grid:
    g = compiler.grid(args[0])
    which = [int(literal(c)) for a in args[1:] for c in ([x for r in a.parts for x in r.parts] if a.kind == "array" else [a])]
    frame = g.frame.select(ORD, *g.cells)
    frame = R.choose_rows(frame, *which) if rows else R.choose_columns(frame, *which)
    return Grid(frame, [c for c in frame.columns if c != ORD])


def _vstack(compiler: Compiler, args: list[Node]) -> Grid:
    grids = [compiler.grid(a) for a in args]
    stacked = R.vstack(*[g.frame.select(ORD, *g.cells) for g in grids])
    numbered = with_ord(stacked.withColumnRenamed(ORD, "_was"), "src", "_was").drop("src", "_was")
    return Grid(numbered, [c for c in numbered.columns if c != ORD and not c.endswith("_error")])


def _hstack(compiler: Compiler, args: list[Node]) -> Grid:
    grids, cells, frames = [compiler.grid(a) for a in args], [], []
    for k, g in enumerate(grids):
        names = [f"h{k}_{c}" for c in g.cells]
        frames.append(g.frame.select(ORD, *[F.col(c).alias(n) for c, n in zip(g.cells, names, strict=True)]))
        cells += names
    return Grid(R.hstack(*frames), cells)


def _to_column(compiler: Compiler, args: list[Node]) -> Grid:
    g = compiler.grid(args[0])
    skip = _int(args, 1, 0)
    by_column = len(args) > 2 and bool(literal(args[2]))
    return _renumbered(Grid(R.to_column(g.frame, g.cells, skip_blanks=bool(skip & 1), by_column=by_column), ["value"]))


def _to_row(compiler: Compiler, args: list[Node]) -> Grid:
    g = compiler.grid(args[0])
    by_column = len(args) > 2 and bool(literal(args[2]))
    made = R.to_row(g.frame, g.cells, skip_blanks=bool(_int(args, 1, 0) & 1), by_column=by_column)
    return Grid(made.withColumn(ORD, F.lit(1).cast("long")), ["cells"])


def _wrap(compiler: Compiler, args: list[Node], rows: bool) -> Grid:
    frame, column = compiler.vector(args[0])
    pad = literal(args[2]) if len(args) > 2 and args[2].kind != "missing" else None
    vector = frame.select(ORD, F.col(column).alias("value"))
    made = (R.wrap_rows if rows else R.wrap_columns)(vector, int(literal(args[1])), pad=pad)
    return Grid(made, [c for c in made.columns if c != ORD])


def _expand(compiler: Compiler, args: list[Node]) -> Grid:
    g = compiler.grid(args[0])
    pad = literal(args[3]) if len(args) > 3 else None
    rows = _int(args, 1, None)
    made = R.expand(g.frame.select(ORD, *g.cells), g.frame.count() if rows is None else rows, dict.fromkeys(g.cells, pad))
    wide = _int(args, 2, len(g.cells))
    if wide < len(g.cells):
        raise R.CellError(VALUE)
    more = [f"_pad{k}" for k in range(wide - len(g.cells))]
    return Grid(made.select("*", *[F.lit(pad).alias(c) for c in more]), [*g.cells, *more])


def _sequence(compiler: Compiler, args: list[Node]) -> Grid:
    rows, columns = _int(args, 0, 1), _int(args, 1, 1)
    start, step = (float(literal(args[k])) if len(args) > k and args[k].kind != "missing" else 1.0 for k in (2, 3))
    if rows < 1 or columns < 1:
        raise R.CellError("#CALC!" if rows == 0 or columns == 0 else VALUE)
    return Grid(R.sequence(compiler.spark, rows, columns, start, step), [f"c{k + 1}" for k in range(columns)])


def _random(compiler: Compiler, args: list[Node]) -> Grid:
    rows, columns = _int(args, 0, 1), _int(args, 1, 1)
    low, high = (float(literal(args[k])) if len(args) > k else d for k, d in ((2, 0.0), (3, 1.0)))
    whole = len(args) > 4 and bool(literal(args[4]))
    return Grid(R.random_array(compiler.spark, rows, columns, low, high, whole=whole), [f"c{k + 1}" for k in range(columns)])


def _lambda(compiler: Compiler, node: Node, params: int) -> Lambda:
    made = lower(node, compiler.scope)
    if not isinstance(made, Lambda) or len(made.names) != params:
        raise R.CellError(VALUE)
    return made


def _applied(compiler: Compiler, function: Lambda, *given: object) -> Val:
    return as_val(lower_value(function.body, function.scope | dict(zip(function.names, given, strict=True))))


def _makearray(compiler: Compiler, args: list[Node]) -> Grid:
    rows, columns, function = int(literal(args[0])), int(literal(args[1])), _lambda(compiler, args[2], 2)
    if rows < 1 or columns < 1:
        raise R.CellError(VALUE)
    made = B.makearray(compiler.spark, rows, columns, lambda r, c: _applied(compiler, function, Val("number", r), Val("number", c)).v)
    return Grid(made, [f"c{k + 1}" for k in range(columns)])


def _map(compiler: Compiler, args: list[Node]) -> Grid:
    function = _lambda(compiler, args[-1], len(args) - 1)
    frame, values = None, []
    for k, a in enumerate(args[:-1]):
        f, column = compiler.vector(a)
        one = f.select(ORD, F.col(column).alias(f"_m{k}"))
        frame = one if frame is None else frame.join(one, ORD, "full")
        values.append(typed(f"_m{k}", dict(f.dtypes)[column]))
    v = _applied(compiler, function, *values)
    return Grid(frame.select(ORD, v.v.alias("value"), v.error()), ["value"])


def _associative(function: Lambda) -> str:
    """The fold that a LAMBDA(acc, value, body) does, if order within it does not matter."""
    body, (acc, value) = function.body, function.names
    names = [str(p.value).lower() for p in body.parts if p.kind == "name"]
    if sorted(names) == sorted([acc, value]) and len(body.parts) == 2:
        if body.kind == "binary" and body.value in ("+", "*"):
            return str(body.value)
        if body.kind == "call" and body.value in ("MAX", "MIN"):
            return str(body.value).lower()
    raise FormulaError("over a table SCAN and REDUCE take acc+v, acc*v, MAX(acc,v) or MIN(acc,v)")


def _seed(args: list[Node]) -> object:
    return None if args[0].kind == "missing" else float(literal(args[0]))


def _scan(compiler: Compiler, args: list[Node]) -> Grid:
    frame, column = compiler.vector(args[1])
    how, seed = _associative(_lambda(compiler, args[2], 2)), _seed(args)
    made = B.scan(frame.select(ORD, F.col(column).cast("double").alias("_v")), "_v", how, [], [ORD], "value")
    value = F.col("value") if seed is None else B.JOINED[how](F.lit(seed), F.col("value"))
    return Grid(made.select(ORD, value.alias("value")), ["value"])


def _reduce(compiler: Compiler, args: list[Node]) -> DataFrame:
    frame, column = compiler.vector(args[1])
    how, seed = _associative(_lambda(compiler, args[2], 2)), _seed(args)
    total = B.ASSOCIATIVE[how](F.col(column).cast("double"))
    value = total if seed is None else F.coalesce(B.JOINED[how](F.lit(seed), total), F.lit(seed))
    return frame.agg(value.alias("value")).withColumn("error", F.when(F.col("value").isNull(), F.lit("#CALC!")))


def _named_fold(node: Node) -> Node:
    """BYROW(x,SUM) is BYROW(x,LAMBDA(v,SUM(v)))."""
    if node.kind == "name" and str(node.value).upper() in AGGREGATES:
        return Node("call", "LAMBDA", [Node("name", "_line"), Node("call", str(node.value).upper(), [Node("name", "_line")])])
    return node


def _byrow(compiler: Compiler, args: list[Node]) -> Grid:
    g, function = compiler.grid(args[0]), _lambda(compiler, _named_fold(args[1]), 1)
    kinds = dict(g.frame.dtypes)
    v = _applied(compiler, function, Line(tuple(typed(c, kinds[c]) for c in g.cells)))
    return Grid(g.frame.select(ORD, v.v.alias("value"), v.error()), ["value"])


def _bycol(compiler: Compiler, args: list[Node]) -> Grid:
    g, function = compiler.grid(args[0]), _lambda(compiler, _named_fold(args[1]), 1)
    inner = Compiler({"g": g.frame.select(ORD, *[F.col(c).alias(f"k{i}") for i, c in enumerate(g.cells)])})
    out = []
    for i in range(len(g.cells)):
        scope = inner.scope | {function.names[0]: inner.scope[f"g.k{i}"]}
        body = _renamed(function.body, function.names[0], f"g.k{i}")
        out.append(as_val(lower_value(body, scope)))
    one = inner.joined(inner.spark.range(1)).select(F.lit(1).cast("long").alias(ORD), *[c for i, v in enumerate(out) for c in (v.v.alias(f"c{i + 1}"), v.error(f"c{i + 1}_error"))])
    return Grid(one, [f"c{i + 1}" for i in range(len(out))])


def _renamed(node: Node, name: str, to: str) -> Node:
    if node.kind == "name" and str(node.value).lower() == name:
        return Node("name", to)
    return Node(node.kind, node.value, [_renamed(p, name, to) for p in node.parts])


# ---------------------------------------------------------------- look-ups


def _keys(compiler: Compiler, node: Node) -> tuple[DataFrame, str]:
    """Keys as a column: of a table, or one that is written out."""
    if compiler.is_grid(node) or compiler.used(node):
        frame, column = compiler.vector(node)
        return frame.select(ORD, F.col(column).alias("_key")), "_key"
    return compiler.spark.createDataFrame([(1, literal(node))], [ORD, "_key"]), "_key"


def _shown(frame: DataFrame) -> Grid:
    return Grid(frame.select(ORD, F.col("found").alias("value"), "error"), ["value"])


def _wild(node: Node) -> bool:
    return node.kind == "text" and any(c in str(node.value) for c in "*?~")


def _vlookup(compiler: Compiler, args: list[Node]) -> Grid:
    keys, key = _keys(compiler, args[0])
    g = compiler.grid(args[1])
    at = int(literal(args[2]))
    if at < 1:
        raise R.CellError(VALUE)
    if at > len(g.cells):
        raise R.CellError("#REF!")
    nearest = bool(literal(args[3])) if len(args) > 3 and args[3].kind != "missing" else True
    table = g.frame.select(F.col(ORD).alias("_at"), F.col(g.cells[0]).alias("_t"), F.col(g.cells[at - 1]).alias("_r"))
    if nearest:
        return _shown(K.lookup_nearest(keys, key, table, "_t", "_r", "_at"))
    return _shown((K.lookup_wildcard if _wild(args[0]) else K.lookup_exact)(keys, key, table, "_t", "_r", "_at"))


def _hlookup(compiler: Compiler, args: list[Node]) -> Grid:
    keys, key = _keys(compiler, args[0])
    g = compiler.grid(args[1])
    if len(args) < 4 or literal(args[3]):
        raise FormulaError("HLOOKUP of a table finds its key exactly: write FALSE as the fourth argument")
    return _shown(K.hlookup(keys, key, g.frame.select(ORD, *g.cells).withColumnRenamed(ORD, "_at"), "_at", int(literal(args[2]))))


def _xlookup(compiler: Compiler, args: list[Node]) -> Grid:
    keys, key = _keys(compiler, args[0])
    wanted, column = compiler.vector(args[1])
    back, returned = compiler.vector(args[2])
    table = wanted.select(F.col(ORD).alias("_at"), F.col(column).alias("_t")).join(back.select(F.col(ORD).alias("_at"), F.col(returned).alias("_r")), "_at")
    missing = literal(args[3]) if len(args) > 3 and args[3].kind != "missing" else None
    mode, way = _int(args, 4, 0), _int(args, 5, 1)
    if mode not in (-1, 0, 1, 2) or way not in (-2, -1, 1, 2) or mode == 2 and abs(way) == 2:
        raise R.CellError(VALUE)
    if mode == 2:
        found = K.lookup_wildcard(keys, key, table, "_t", "_r", "_at", last=way == -1)
    elif mode == 0:  # the halving modes find the same row where keys are sorted, as they ask for
        found = K.lookup_exact(keys, key, table, "_t", "_r", "_at", last=way < 0)
    else:
        found = K.lookup_nearest(keys, key, table, "_t", "_r", "_at", larger=mode == 1, exact_first=way > 0)
    if missing is not None:
        found = found.withColumn("found", F.when(F.col("error").isNull(), F.col("found")).otherwise(F.lit(missing))).withColumn("error", F.lit(None).cast("string"))
    return _shown(found)


def _match(compiler: Compiler, args: list[Node]) -> DataFrame | Grid:
    kind = _int(args, 2, 1)
    frame, column = compiler.vector(args[1])
    if compiler.is_grid(args[0]):
        keys, key = _keys(compiler, args[0])
        table = frame.select(F.col(ORD).alias("_at"), F.col(column).alias("_t"))
        if kind < 0:
            raise FormulaError("MATCH -1 of a table takes one key")
        return _shown(K.lookup_nearest(keys, key, table, "_t", "_at", "_at") if kind else K.lookup_exact(keys, key, table, "_t", "_at", "_at")).named()
    key = literal(args[0])
    if kind == 0:
        if isinstance(key, str):
            return K.match_wildcard(frame, column, key, ORD)
        return frame.where(F.col(column) == key).agg(F.min(ORD).alias("value")).withColumn("error", F.when(F.col("value").isNull(), F.lit("#N/A")))
    return K.match_place(frame, column, key, ORD, kind)


def _index(compiler: Compiler, args: list[Node]) -> DataFrame:
    g = compiler.grid(args[0])
    row, column = _int(args, 1, 1), _int(args, 2, 1)
    if not 1 <= column <= len(g.cells):
        raise R.CellError("#REF!")
    return K.index_row(g.frame, ORD, row, g.cells[column - 1])


#: Functions that give rows in order.
GRIDS: dict[str, Callable[[Compiler, list[Node]], Grid]] = {
    "FILTER": _filter, "SORT": _sort, "SORTBY": _sortby, "UNIQUE": _unique, "TAKE": lambda c, a: _take(c, a, True), "DROP": lambda c, a: _take(c, a, False),
    "CHOOSECOLS": lambda c, a: _chosen(c, a, False), "CHOOSEROWS": lambda c, a: _chosen(c, a, True), "VSTACK": _vstack, "HSTACK": _hstack, "TOCOL": _to_column, "TOROW": _to_row,
    "WRAPROWS": lambda c, a: _wrap(c, a, True), "WRAPCOLS": lambda c, a: _wrap(c, a, False), "EXPAND": _expand, "SEQUENCE": _sequence, "RANDARRAY": _random,
    "MAKEARRAY": _makearray, "MAP": _map, "SCAN": _scan, "BYROW": _byrow, "BYCOL": _bycol, "VLOOKUP": _vlookup, "HLOOKUP": _hlookup, "XLOOKUP": _xlookup,
}

#: Functions that give one value, or a value for each key.
ROWS: dict[str, Callable[[Compiler, list[Node]], DataFrame]] = {"REDUCE": _reduce, "MATCH": _match, "INDEX": _index}


def table_formula(tables: dict[str, DataFrame], formula: str) -> DataFrame:
    """The result of a formula over tables; an error that its arguments alone make is one row with its code."""
    compiler = Compiler(tables)
    roomy(compiler.spark)
    try:
        return compiler.run(formula)
    except R.CellError as bad:
        return compiler.spark.range(1).select(F.lit(None).cast("double").alias("value"), F.lit(str(bad)).alias("error"))


__all__ = ["Compiler", "Grid", "table_formula"]
