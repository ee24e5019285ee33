"""The criteria mini-language: a literal criterion becomes one predicate.

A criterion is an optional comparison and an operand: blank, number, logical, or text with
the wildcards * ? ~. On a typed column it compiles to a plain comparison, which Parquet
filters take.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import wildcard_regex
from tabulon.functions.values import DIV0, NUMERIC, Val, fold

_OPERATORS = ("<=", ">=", "<>", "<", ">", "=")


def _compare(c: Column, op: str, x: object) -> Column:
    return {"=": c == x, "<>": ~F.equal_null(c, F.lit(x)), "<": c < x, "<=": c <= x, ">": c > x, ">=": c >= x}[op]


def criterion(column: Column, kind: str, given: object, *, counting: bool = True) -> Column:
    """The predicate of a criterion on a column of kind number, text or bool.

    counting picks the dialect of the COUNTIF family; the SUMIF family reads "TRUE" as text and
    a number literal as numbers only.
    """
    if isinstance(given, bool):
        return column == given if kind == "bool" else F.lit(False)
    if isinstance(given, int | float):
        if kind == "number":
            return column == float(given)
        return (F.trim(column).rlike(NUMERIC) & (F.trim(column).try_cast("double") == float(given))) if kind == "text" and counting else F.lit(False)
    op = next((o for o in _OPERATORS if given.startswith(o)), "")
    operand, op = given[len(op) :], op or "="
    if operand == "":
        blank = column.isNull() if kind != "text" or given in ("=", "<>") else column.isNull() | (column == "")
        return blank if op == "=" else ~blank if op == "<>" else F.lit(False)
    if re.match(NUMERIC, operand.strip()):
        x = float(operand)
        if kind == "number":
            return _compare(column, op, x)
        if kind == "text":
            numeric = F.trim(column).rlike(NUMERIC)
            value = F.when(numeric, F.trim(column).try_cast("double"))
            return F.coalesce(numeric & _compare(value, op, x), F.lit(False)) if op != "<>" else ~F.coalesce(numeric & (value == x), F.lit(False))
        return F.lit(op == "<>")
    if counting and operand.upper() in ("TRUE", "FALSE") and kind != "text":
        return _compare(column, op, operand.upper() == "TRUE") if kind == "bool" else F.lit(op == "<>")
    if kind != "text":
        return F.lit(op == "<>")
    if op in ("=", "<>"):
        if re.search(r"[*?]", operand):
            hit = column.rlike("(?s)^" + re.sub(r"[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", wildcard_regex(operand)) + "$")
        else:
            hit = _same_text(column, operand.replace("~~", "~"))
        return hit if op == "=" else ~F.coalesce(hit, F.lit(False))
    return _compare(fold(column), op, re.sub("[A-Z]", lambda m: m[0].lower(), operand))


def _same_text(column: Column, wanted: str) -> Column:
    """Equal without case; short texts as a list of their spellings, which Parquet filters take."""
    letters = [k for k, c in enumerate(wanted) if re.match("[A-Za-z]", c)]
    if len(letters) > 4:
        return fold(column) == re.sub("[A-Z]", lambda m: m[0].lower(), wanted)
    spellings = [""]
    for c in wanted:
        both = sorted({c.lower(), c.upper()}) if re.match("[A-Za-z]", c) else [c]
        spellings = [s + b for s in spellings for b in both]
    return column.isin(*spellings)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def sumifs(value: Column, *tests: Column) -> Column:
    return F.coalesce(F.sum(F.when(_all(list(tests)), value.cast("double"))), F.lit(0.0))


def countifs(*tests: Column) -> Column:
    return F.count_if(_all(list(tests)))


def averageifs(value: Column, *tests: Column) -> Val:
    picked = F.when(_all(list(tests)), value.cast("double"))
    return Val("number", F.avg(picked), F.when(F.count(picked) == 0, F.lit(DIV0)))


def sumifs_where(frame: DataFrame, value: str, *tests: Column) -> DataFrame:
    """SUMIFS of a whole table as a filter, so that the criteria reach the scan."""
    return frame.where(_all(list(tests))).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("value"))
