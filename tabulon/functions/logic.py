"""Operators, comparison, control flow and information."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.values import (
    DIV0, FUNCTIONS, NA, NAME, NULL, NUM, REF, VALUE, Val, as_val, cast_to, down, error, first_error, fold, function, guarded, num, r15, truth, txt,
)


def add(a: object, b: object) -> Val:
    a, b = num(a), num(b)
    return guarded("number", a.v + b.v, first_error(a.e, b.e))


def subtract(a: object, b: object) -> Val:
    a, b = num(a), num(b)
    return guarded("number", a.v - b.v, first_error(a.e, b.e))


def multiply(a: object, b: object) -> Val:
    a, b = num(a), num(b)
    return guarded("number", a.v * b.v, first_error(a.e, b.e))


def divide(a: object, b: object) -> Val:
    a, b = num(a), num(b)
    return Val("number", F.try_divide(a.v, b.v), first_error(a.e, b.e, F.when(b.v == 0, F.lit(DIV0))))


def negate(a: object) -> Val:
    a = num(a)
    return Val("number", -a.v, a.e)


def percent(a: object) -> Val:
    a = num(a)
    return Val("number", a.v / 100, a.e)


def concatenate(a: object, b: object) -> Val:
    a, b = txt(a), txt(b)
    return guarded("text", F.concat(a.v, b.v), first_error(a.e, b.e))


def _same(a: Val, b: Val) -> Column:
    """Equality without errors: numbers at 15 digits, text without case, blank as 0, "" and FALSE."""
    kinds = {a.kind, b.kind}
    if kinds <= {"text", "blank"}:
        return fold(txt(a).v) == fold(txt(b).v)
    if "text" in kinds:  # a number or logical equals text only where both are blank
        other = b if a.kind == "text" else a
        words = a if a.kind == "text" else b
        blank = words.v.isNull()
        zero = ~truth(other).v
        return (blank & zero) | (other.v.isNull() & (F.coalesce(words.v, F.lit("")) == ""))
    x, y = num(a).v, num(b).v
    return (x == y) | (r15(x) == r15(y))


def equal(a: object, b: object) -> Val:
    a, b = as_val(a), as_val(b)
    return guarded("bool", _same(a, b), first_error(a.e, b.e))


def unequal(a: object, b: object) -> Val:
    same = equal(a, b)
    return Val("bool", ~same.v, same.e)


_RANK = {"number": 0, "blank": 0, "text": 1, "bool": 2}


def less(a: object, b: object) -> Val:
    """Numbers below text below logicals, a blank is the number 0; text without case."""
    a, b = as_val(a), as_val(b)
    if _RANK[a.kind] == _RANK[b.kind] == 0:
        below = num(a).v < num(b).v
    else:
        if a.kind == b.kind:
            below = fold(a.v) < fold(b.v) if a.kind == "text" else a.v < b.v
        else:
            below = F.lit(_RANK[a.kind] < _RANK[b.kind])
        # a blank meets numbers as 0, and is below all else
        no_a = num(b).v > 0 if _RANK[b.kind] == 0 else b.v.isNotNull()
        no_b = num(a).v < 0 if _RANK[a.kind] == 0 else F.lit(False)
        if _RANK[a.kind]:
            below = F.when(a.v.isNull(), no_a).otherwise(below)
        if _RANK[b.kind]:
            below = F.when(a.v.isNotNull() & b.v.isNull(), no_b).otherwise(below)
    return guarded("bool", below, first_error(a.e, b.e))


def greater(a: object, b: object) -> Val:
    return less(b, a)


def at_most(a: object, b: object) -> Val:
    over = greater(a, b)
    return Val("bool", ~over.v, over.e)


def at_least(a: object, b: object) -> Val:
    under = less(a, b)
    return Val("bool", ~under.v, under.e)


def _common(*vals: Val) -> str:
    kinds = {v.kind for v in vals} - {"blank"}
    return kinds.pop() if len(kinds) == 1 else "text" if kinds else "blank"


def _as(v: Val, kind: str) -> Column:
    """The value in the branch type; blanks stay blank."""
    if v.kind == kind or kind == "blank":
        return v.v
    if v.kind == "blank":
        return F.lit(None).cast({"number": "double", "text": "string", "bool": "boolean"}[kind])
    return F.when(v.v.isNotNull(), cast_to(v, kind).v)


def _err(v: Val) -> Column:
    return F.lit(None).cast("string") if v.e is None else v.e


def choose_case(cases: list[tuple[Column, Val]], other: Val, before: Column | None = None) -> Val:
    """The first case whose condition holds; branches of unlike types become text."""
    kind = _common(*[v for _, v in cases], other)
    value, err = _as(other, kind), _err(other)
    for condition, v in reversed(cases):
        value, err = F.when(condition, _as(v, kind)).otherwise(value), F.when(condition, _err(v)).otherwise(err)
    none = all(v.e is None for _, v in cases) and other.e is None
    return guarded(kind, value, first_error(before, None if none else err))


def if_(condition: object, then: object = None, otherwise: object = False) -> Val:
    c = truth(condition)
    return c if then is None and otherwise is False else choose_case([(c.v, as_val(then))], as_val(otherwise), c.e)


def ifs(*pairs: object) -> Val:
    """Every pair is evaluated; the first error, left to right, wins over a TRUE."""
    if len(pairs) % 2 or not pairs:
        return error(VALUE)
    conditions, values = [truth(c) for c in pairs[::2]], [as_val(v) for v in pairs[1::2]]
    errors = first_error(*[e for c, v in zip(conditions, values, strict=True) for e in (c.e, v.e)])
    return choose_case([(c.v, v) for c, v in zip(conditions, values, strict=True)], error(NA), errors)


def iferror(value: object, other: object) -> Val:
    v = as_val(value)
    return v if v.e is None else choose_case([(v.e.isNull(), Val(v.kind, v.v))], as_val(other))


def ifna(value: object, other: object) -> Val:
    v = as_val(value)
    return v if v.e is None else choose_case([(F.coalesce(v.e == NA, F.lit(False)), as_val(other))], v)


def switch(key: object, *rest: object) -> Val:
    if len(rest) < 2:
        return error(VALUE)
    k, pairs = as_val(key), list(zip(rest[::2], rest[1::2], strict=False))
    other = as_val(rest[-1]) if len(rest) % 2 else error(NA)
    return choose_case([(_same(k, as_val(v)), as_val(r)) for v, r in pairs], other, first_error(k.e, *[as_val(v).e for v, _ in pairs]))


def _logicals(args: tuple, fold_, empty: bool) -> Val:
    if not args:
        return error(VALUE)
    vals = [as_val(a) for a in args]
    errors = first_error(*[e for v in vals for e in (v.e, F.when(v.v.isNotNull(), F.lit(VALUE)) if v.kind == "text" else None)])
    known = F.array(*[F.when(v.v.isNotNull(), truth(v).v) for v in vals if v.kind != "text"])
    return guarded("bool", F.when(F.size(F.array_compact(known)) == 0, F.lit(empty)).otherwise(fold_(F.array_compact(known))), errors)


def and_(*args: object) -> Val:
    """Blanks are skipped, text is #VALUE!, nothing left is TRUE."""
    return _logicals(args, lambda x: F.forall(x, lambda b: b), True)


def or_(*args: object) -> Val:
    return _logicals(args, lambda x: F.exists(x, lambda b: b), False)


def xor(*args: object) -> Val:
    return _logicals(args, lambda x: F.size(F.filter(x, lambda b: b)) % 2 == 1, False)


@function("NOT", "b", "bool")
def not_(b):
    return ~b


def choose(index: object, *values: object) -> Val:
    i = num(index)
    at = down(i.v)
    return choose_case([(at == k + 1, as_val(v)) for k, v in enumerate(values)], error(VALUE), i.e)


def _test(name: str, test) -> None:
    FUNCTIONS[name] = lambda x, test=test: Val("bool", test(as_val(x)))


def _is(v: Val, *kinds: str) -> Column:
    clean = F.lit(True) if v.e is None else v.e.isNull()
    return clean & v.v.isNotNull() & F.lit(v.kind in kinds)


def _failed(v: Val) -> Column:
    return F.lit(False) if v.e is None else v.e.isNotNull()


_test("ISBLANK", lambda v: v.v.isNull() & ~_failed(v))
_test("ISNUMBER", lambda v: _is(v, "number"))
_test("ISTEXT", lambda v: _is(v, "text"))
_test("ISLOGICAL", lambda v: _is(v, "bool"))
_test("ISNONTEXT", lambda v: ~_is(v, "text"))
_test("ISERROR", _failed)
_test("ISERR", lambda v: F.lit(False) if v.e is None else F.coalesce(v.e != NA, F.lit(False)))
_test("ISNA", lambda v: F.lit(False) if v.e is None else F.coalesce(v.e == NA, F.lit(False)))


def type_(x: object) -> Val:
    v = as_val(x)
    code = {"number": 1.0, "blank": 1.0, "text": 2.0, "bool": 4.0}[v.kind]
    return Val("number", F.when(_failed(v), 16.0).when(v.v.isNull(), 1.0).otherwise(code))


#: The number of each error code.
ERROR_NUMBERS = {NULL: 1, DIV0: 2, VALUE: 3, REF: 4, NAME: 5, NUM: 6, NA: 7, "#GETTING_DATA": 8}


def error_type(x: object) -> Val:
    v = as_val(x)
    if v.e is None:
        return error(NA)
    code = functools.reduce(lambda c, item: c.when(v.e == item[0], float(item[1])), list(ERROR_NUMBERS.items())[1:], F.when(v.e == NULL, 1.0))
    return Val("number", code, F.when(code.isNull(), F.lit(NA)))


FUNCTIONS |= {
    "IF": if_, "IFS": ifs, "IFERROR": iferror, "IFNA": ifna, "SWITCH": switch, "AND": and_, "OR": or_, "XOR": xor, "CHOOSE": choose,
    "TRUE": lambda: Val("bool", F.lit(True)), "FALSE": lambda: Val("bool", F.lit(False)), "NA": lambda: error(NA), "TYPE": type_, "ERROR.TYPE": error_type,
}
