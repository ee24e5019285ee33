"""Cell values in Python: None (blank), float, str, bool, Err, and a list of rows for an array."""

from __future__ import annotations

import math
import re
from decimal import Decimal

NULL, DIV0, VALUE, REF, NAME, NUM, NA, CALC, CIRCULAR = "#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#CALC!", "#CIRCULAR!"

NUMERIC = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Err(str):
    """An error code as a value."""

    __slots__ = ()


class Fail(Exception):
    """Ends a function with an error value."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = Err(code)


def is_text(x: object) -> bool:
    return isinstance(x, str) and not isinstance(x, Err)


def is_number(x: object) -> bool:
    return isinstance(x, float)


def top_left(x: object) -> object:
    while isinstance(x, list):
        x = x[0][0] if x and x[0] else None
    return x


def checked(x: object) -> object:
    if isinstance(x, Err):
        raise Fail(x)
    return x


def numeric_text(t: str) -> float | None:
    t = t.strip()
    if NUMERIC.fullmatch(t):
        return float(t)
    return float(t) if re.fullmatch(r"[+-]?(?:inf|infinity|nan)", t, re.I) else None


def num(x: object) -> float:
    checked(x)
    if x is None:
        return 0.0
    if isinstance(x, bool):
        return 1.0 if x else 0.0
    if isinstance(x, str):
        n = numeric_text(x)
        if n is None:
            raise Fail(VALUE)
        return n
    if isinstance(x, float):
        return x
    raise Fail(VALUE)


def plain(n: float) -> str:
    """A number as & shows it: no exponent, no trailing zeros."""
    if math.isinf(n) or math.isnan(n):
        return "NaN" if math.isnan(n) else "inf" if n > 0 else "-inf"
    if n == int(n) and abs(n) < 1e15:
        return "-0" if n == 0 and math.copysign(1, n) < 0 else str(int(n))
    shown = format(Decimal(repr(n)), "f")
    return shown.removesuffix(".0")


def txt(x: object) -> str:
    checked(x)
    if x is None:
        return ""
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, float):
        return plain(x)
    if isinstance(x, str):
        return x
    raise Fail(VALUE)


def truth(x: object) -> bool:
    checked(x)
    if x is None:
        return False
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return x != 0
    raise Fail(VALUE)


def fold(t: str) -> str:
    """Lower case of A-Z only."""
    return t.translate(_FOLD)


def half_away(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x) if math.isfinite(x) and abs(x) < 2**53 else x


def r15(n: float) -> float:
    """Rounded to 15 significant digits."""
    if n == 0 or not math.isfinite(n):
        return n
    k = 14 - math.floor(math.log10(abs(n)))
    if abs(k) > 308:
        return n
    scaled = n * 10.0**k
    return half_away(scaled) / 10.0**k if math.isfinite(scaled) else n


def same_number(a: float, b: float) -> bool:
    return a == b or r15(a) == r15(b)


def same(a: object, b: object) -> bool:
    """The = operator on values that are no errors."""
    if a is None and b is None:
        return True
    if a is None or b is None:
        other = b if a is None else a
        if is_text(other):
            return other == ""
        return not other if isinstance(other, bool | float) else False
    if is_text(a) and is_text(b):
        return fold(a) == fold(b)
    if is_text(a) or is_text(b):
        return False
    if isinstance(a, bool | float) and isinstance(b, bool | float):
        return same_number(float(a), float(b))
    return a == b


def rank(x: object) -> int:
    return 1 if is_text(x) else 2 if isinstance(x, bool) else 3 if isinstance(x, Err) else 0


def order(a: object, b: object) -> int:
    """-1, 0 or 1: numbers below text below logicals; a blank is the number 0."""
    a, b = 0.0 if a is None else a, 0.0 if b is None else b
    if rank(a) != rank(b):
        return -1 if rank(a) < rank(b) else 1
    if is_text(a):
        a, b = fold(a).encode("utf-8", "surrogatepass"), fold(b).encode("utf-8", "surrogatepass")
    return (a > b) - (a < b)


def grid(x: object) -> list[list[object]]:
    return x if isinstance(x, list) else [[x]]


def flat(x: object):
    if isinstance(x, list):
        for row in x:
            for c in row:
                yield from flat(c)
    else:
        yield x


def shape(g: list[list[object]]) -> tuple[int, int]:
    return len(g), max((len(r) for r in g), default=0)


def tidy(x: object) -> object:
    """A result: -0 is 0, a grid of one cell is still a grid."""
    return 0.0 if isinstance(x, float) and x == 0 else x
