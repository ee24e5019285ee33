"""Math, rounding and number tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.values import DIV0, FUNCTIONS, NUM, Val, as_val, down, function, guarded, half_away, num, r15, trunc0
from tabulon.functions.values import up as ceil_

_lit = F.lit


def _scaled(n: Column, d: Column, to_whole) -> Column:
    """sign(n) * to_whole(|n| * 10^d) / 10^d, dividing by 10^-d where d is negative."""
    p = F.pow(_lit(10.0), F.abs(d))
    fine, coarse = to_whole(F.abs(n) * p) / p, to_whole(F.abs(n) / p) * p
    # from 2^53 on there are no more digits to cut
    return F.when((d >= 0) & (F.abs(n) * p >= 2.0**53), n).otherwise(F.signum(n) * F.when(d >= 0, fine).otherwise(F.when(d < -308, 0.0).otherwise(coarse)))


def _snap(x: Column) -> Column:
    """x, or the integer that it misses by a rounding error."""
    whole = down(x + 0.5)
    return F.when(F.abs(x - whole) <= F.abs(x) * 1e-14 + 1e-14, whole).otherwise(x)


def _snap_half(x: Column) -> Column:
    twice = down(2 * x + 0.5)
    return F.when(F.abs(2 * x - twice) <= 2 * (F.abs(x) * 1e-14 + 1e-14), twice / 2).otherwise(x)


@function("ABS", "n", "number")
def abs_(n):
    return F.abs(n)


@function("SIGN", "n", "number")
def sign(n):
    return F.signum(n)


def _int(n: Column) -> Column:
    below = down(n)
    gap = below + 1 - n
    near = (gap < 0.5) & (gap <= 5e-15 * F.greatest(F.abs(below + 1), _lit(1.0)))
    return F.when(near & (n != below), below + 1).otherwise(below)


@function("INT", "n", "number")
def int_(n):
    """Down, but up over a gap that is a rounding error."""
    return _int(n)


@function("TRUNC", "n i=0", "number")
def trunc(n, d):
    return _scaled(n, d, down)


@function("ROUND", "n i=0", "number")
def round_(n, d):
    """Half away from zero, halves found within a rounding error."""
    return _scaled(n, d, lambda x: down(_snap_half(x) + 0.5))


@function("ROUNDUP", "n i=0", "number")
def roundup(n, d):
    return _scaled(n, d, lambda x: ceil_(_snap(x)))


@function("ROUNDDOWN", "n i=0", "number")
def rounddown(n, d):
    return _scaled(n, d, lambda x: down(_snap(x)))


def _multiple(n: Column, s: Column, up: bool) -> Column:
    q = F.try_divide(n, s)
    near = half_away(q)
    close = F.abs(q - near) <= 5e-15 * F.greatest(F.abs(near), _lit(1.0))
    # whole numbers are divided exactly: their remainder has the sign of s
    whole = (n == trunc0(n)) & (s == trunc0(s)) & (F.greatest(F.abs(n), F.abs(s)) <= 2.0**53) & (s != 0)
    r = F.try_mod(n, s)
    over = F.when((r != 0) & ((r < 0) != (s < 0)), r + s).otherwise(r)
    exact = F.when(over == 0, n).otherwise(n - over + s) if up else n - over
    return F.when(whole, exact).when(close, r15(s * near)).otherwise(s * (ceil_(q) if up else down(q)))


@function("FLOOR", "n n", "number")
def floor(n, s):
    value = F.when(s == 0, _lit(0.0)).when(s == 1, _int(n)).otherwise(_multiple(n, s, False))
    return value, [((n > 0) & (s < 0), NUM), ((s == 0) & (n != 0), DIV0)]


@function("CEILING", "n n", "number")
def ceiling(n, s):
    return F.when(s == 0, _lit(0.0)).otherwise(_multiple(n, s, True)), [((n > 0) & (s < 0), NUM), ((s == 0) & (n != 0), DIV0)]


@function("FLOOR.MATH", "n n=1 n=0", "number")
def floor_math(n, s, mode):
    step = F.abs(s)
    to_zero = (n < 0) & (mode != 0)
    return F.when(s == 0, _lit(0.0)).when(to_zero, _multiple(n, step, True)).otherwise(_multiple(n, step, False))


@function("CEILING.MATH", "n n=1 n=0", "number")
def ceiling_math(n, s, mode):
    step = F.abs(s)
    from_zero = (n < 0) & (mode != 0)
    return F.when(s == 0, _lit(0.0)).when(from_zero, _multiple(n, step, False)).otherwise(_multiple(n, step, True))


@function("MOD", "n n", "number")
def mod(n, d):
    """The sign of the divisor."""
    return n - d * down(F.try_divide(n, d)), [(d == 0, DIV0)]


@function("SQRT", "n", "number")
def sqrt(n):
    return F.when(n >= 0, F.sqrt(n)), [(n < 0, NUM)]


@function("POWER", "n n", "number", finite=True)
def power(a, b):
    bad = ((a == 0) & (b == 0)) | ((a < 0) & (b != down(b)))
    return F.when(~bad, F.pow(a, b)), [(bad, NUM), ((a == 0) & (b < 0), DIV0)]


@function("PI", "", "number")
def pi():
    return F.pi()


@function("ISEVEN", "i", "bool")
def iseven(n):
    return n % 2 == 0


@function("ISODD", "i", "bool")
def isodd(n):
    return n % 2 != 0


def n_(x: object) -> Val:
    """A number as it is, TRUE 1, text and blanks 0; errors stay."""
    a = as_val(x)
    return guarded("number", _lit(0.0), a.e) if a.kind == "text" else num(a)


FUNCTIONS["N"] = n_
