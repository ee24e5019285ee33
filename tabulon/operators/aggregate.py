"""Whole-range aggregates over typed columns; a null is a blank cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.values import DIV0, Val


def total(c: Column) -> Column:
    """SUM: numbers only, 0 if there is none."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def product(c: Column) -> Column:
    """PRODUCT: 0 if there is no number."""
    return F.coalesce(F.product(c.cast("double")), F.lit(0.0))


def average(c: Column) -> Val:
    """AVERAGE: #DIV/0! if there is no number."""
    return Val("number", F.avg(c.cast("double")), F.when(F.count(c) == 0, F.lit(DIV0)))


def least(c: Column) -> Column:
    return F.coalesce(F.min(c.cast("double")), F.lit(0.0))


def greatest(c: Column) -> Column:
    return F.coalesce(F.max(c.cast("double")), F.lit(0.0))


def count_numbers(c: Column) -> Column:
    return F.count(c)


def count_filled(c: Column) -> Column:
    """COUNTA: everything but blanks; empty text counts."""
    return F.count(c)


def count_blank(c: Column) -> Column:
    """COUNTBLANK: blanks and, in text columns, empty text."""
    return F.count_if(c.isNull() | (c.cast("string") == ""))


def sumproduct(*columns: Column) -> Column:
    """SUMPRODUCT: the sum of row products; logicals given as conditions count as 1 and 0."""
    out = F.lit(1.0)
    for c in columns:
        out = out * F.coalesce(c.cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(out), F.lit(0.0))


def all_true(c: Column) -> Column:
    return F.coalesce(F.bool_and(c != 0), F.lit(True))


def any_true(c: Column) -> Column:
    return F.coalesce(F.bool_or(c != 0), F.lit(False))


def odd_true(c: Column) -> Column:
    return F.count_if(c != 0) % 2 == 1
