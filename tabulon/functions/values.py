"""Worksheet values as Spark expressions.

A ``Val`` is a typed column with a second column for its error code. A null value without an
error is a blank cell. The error column is None where no row can have an error, which keeps
plans small: expressions on clean numeric columns stay bare arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NULL, DIV0, VALUE, REF, NAME, NUM, NA, CALC = "#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#CALC!"

#: Text that counts as a number: an optional sign, digits with a point, an exponent.
NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Values of more weight than this are bound once where a formula uses them.
HEAVY = 8


@dataclass(frozen=True)
class Val:
    """kind: number, text, bool or blank; v: the value; e: the error code, or None for never.

    s is the struct that v and e are fields of, if there is one; w tells about how large the
    expression is.
    """

    kind: str
    v: Column
    e: Column | None = None
    s: Column | None = None
    w: int = 1

    def packed(self) -> Column:
        """Value and error as one struct."""
        return F.struct(self.v.alias("v"), self.error("e")) if self.s is None else self.s

    def unpacked(self, t: Column) -> Val:
        """This value where its struct is bound to t."""
        return Val(self.kind, t["v"], None if self.e is None else t["e"])

    def column(self, name: str = "value") -> Column:
        return self.v.alias(name)

    def error(self, name: str = "error") -> Column:
        return (F.lit(None).cast("string") if self.e is None else self.e).alias(name)


def number(column: Column | str) -> Val:
    return Val("number", (F.col(column) if isinstance(column, str) else column).cast("double"))


def text(column: Column | str) -> Val:
    return Val("text", F.col(column) if isinstance(column, str) else column)


def boolean(column: Column | str) -> Val:
    return Val("bool", F.col(column) if isinstance(column, str) else column)


def error(code: str) -> Val:
    return Val("number", F.lit(None).cast("double"), F.lit(code))


def serial(column: Column | str) -> Val:
    """A date or timestamp column as a serial number (days; 1900-01-01 is 1)."""
    c = F.col(column) if isinstance(column, str) else column
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    days = F.datediff(c.cast("date"), F.lit("1899-12-30").cast("date"))
    return Val("number", (days + seconds / 86400).cast("double"))


def as_val(x: object) -> Val:
    if isinstance(x, Val):
        return x
    if isinstance(x, bool):
        return Val("bool", F.lit(x))
    if isinstance(x, int | float):
        return Val("number", F.lit(float(x)))
    if isinstance(x, str):
        return Val("text", F.lit(x))
    if x is None:
        return Val("blank", F.lit(None).cast("double"))
    raise TypeError(f"{x!r} has no worksheet type: wrap columns in number, text, boolean or serial")


def first_error(*errors: Column | None) -> Column | None:
    known = [e for e in errors if e is not None]
    return None if not known else known[0] if len(known) == 1 else F.coalesce(*known)


def guarded(kind: str, value: Column, err: Column | None) -> Val:
    return Val(kind, value if err is None else F.when(err.isNull(), value), err)


def num(x: object) -> Val:
    """To a number: blank 0, TRUE 1, numeric text parsed, other text #VALUE!."""
    a = as_val(x)
    if a.kind == "number":
        return Val("number", F.coalesce(a.v, F.lit(0.0)) if a.e is None else F.when(a.e.isNull(), F.coalesce(a.v, F.lit(0.0))), a.e)
    if a.kind == "blank":
        return Val("number", F.lit(0.0))
    if a.kind == "bool":
        return Val("number", F.coalesce(a.v.cast("double"), F.lit(0.0)), a.e)
    clean = F.trim(a.v)
    good = clean.rlike(NUMERIC)
    err = first_error(a.e, F.when(a.v.isNotNull() & ~good, F.lit(VALUE)))
    return Val("number", F.when(a.v.isNull(), F.lit(0.0)).when(good, clean.try_cast("double")), err)


def down(v: Column) -> Column:
    """Floor as a double; from 2^53 on a double is whole, and a bigint may not hold it."""
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)


def up(v: Column) -> Column:
    """Ceiling as a double."""
    return F.when(F.abs(v) < 2.0**53, F.ceil(v).cast("double")).otherwise(v)


def as_int(v: Column) -> Column:
    """A number as an int, brought into half its range so that two of them can be added."""
    return F.greatest(F.least(v, F.lit(float(1 << 30))), F.lit(-float(1 << 30))).cast("int")


def plain(v: Column) -> Column:
    """A number as & shows it: no exponent, no trailing zeros."""
    shortest = v.cast("string")
    digits = F.regexp_replace(F.translate(F.regexp_extract(shortest, r"^-?([0-9.]+)E", 1), ".", ""), "0+$", "")
    power = F.regexp_extract(shortest, r"E(-?[0-9]+)$", 1).try_cast("int")
    fraction = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    moved = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    expanded = F.concat(F.when(v < 0, "-").otherwise(""), F.when(power < 0, fraction).otherwise(moved))
    small = F.abs(v) < 1e15
    return F.when(shortest == "-0.0", "-0").when(small & (v == F.floor(v)), F.when(small, v).cast("bigint").cast("string")).when(~shortest.contains("E"), shortest).otherwise(expanded)


def txt(x: object) -> Val:
    """To text: blank "", TRUE "TRUE", a number as ``plain`` shows it."""
    a = as_val(x)
    if a.kind == "text":
        shown = a.v
    elif a.kind == "bool":
        shown = F.when(a.v, "TRUE").when(~a.v, "FALSE")
    elif a.kind == "blank":
        return Val("text", F.lit(""))
    else:
        shown = plain(a.v)
    return guarded("text", F.coalesce(shown, F.lit("")), a.e)


def truth(x: object) -> Val:
    """To a logical: numbers by being nonzero, blank FALSE, text #VALUE!."""
    a = as_val(x)
    if a.kind == "bool":
        return guarded("bool", F.coalesce(a.v, F.lit(False)), a.e)
    if a.kind in ("number", "blank"):
        return guarded("bool", F.coalesce(a.v != 0, F.lit(False)), a.e)
    return Val("bool", F.when(a.v.isNull(), F.lit(False)), first_error(a.e, F.when(a.v.isNotNull(), F.lit(VALUE))))


def fold(v: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(v, _UPPER, _LOWER)


def bind(columns: list[Column], body: Callable[..., Column]) -> Column:
    """body(columns) with each column computed once a row, however often body names it.

    Formulas that use an argument many times would otherwise repeat its whole expression.
    """
    held = F.array(F.struct(*[c.alias(f"_{k}") for k, c in enumerate(columns)]))
    return F.element_at(F.transform(held, lambda t: body(*[t[f"_{k}"] for k in range(len(columns))])), 1)


def roomy(spark: SparkSession) -> None:
    """Let the analyzer take as many rounds as formulas of nested calls need; it stops when it is done."""
    key = "spark.sql.analyzer.maxIterations"
    if int(spark.conf.get(key)) < 2000:
        spark.conf.set(key, "2000")


def with_bound(vals: list[object], body: Callable[[list[object]], object]) -> object:
    """body(vals) with every heavy value computed once a row.

    The result is body's own where nothing is heavy, or where it is no value (a function).
    """
    heavy = [k for k, x in enumerate(vals) if isinstance(x, Val) and x.w > HEAVY]
    if not heavy:
        return body(vals)
    kept: list[object] = []

    def inside(*t: Column) -> Column:
        light = list(vals)
        for k, c in zip(heavy, t, strict=True):
            light[k] = vals[k].unpacked(c)
        found = body(light)
        kept[:] = [found]
        return as_val(found).packed() if isinstance(found, Val | bool | int | float | str) or found is None else F.lit(None)

    made = bind([vals[k].packed() for k in heavy], inside)
    found = kept[0]
    if not isinstance(found, Val):
        return found if isinstance(found, bool | int | float | str) or found is None else body(vals)
    return Val(found.kind, made["v"], None if found.e is None else made["e"], made, HEAVY + 1)


def weighed(x: object, *parts: object) -> object:
    """A value made of parts, with their weight."""
    if not isinstance(x, Val) or x.w > HEAVY:
        return x
    return replace(x, w=1 + sum(p.w for p in parts if isinstance(p, Val)))


def trunc0(v: Column) -> Column:
    """Toward zero."""
    return F.when(v < 0, up(v)).otherwise(down(v))


def half_away(v: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.signum(v) * down(F.abs(v) + 0.5)


def r15(v: Column) -> Column:
    """Rounded to 15 significant digits."""
    k = 14 - F.floor(F.log10(F.abs(v))).cast("int")
    scale = F.pow(F.lit(10.0), k.cast("double"))
    down = F.pow(F.lit(10.0), (-k).cast("double"))
    safe = (v != 0) & (F.abs(k) <= 300)
    return F.when(safe, F.when(k >= 0, half_away(v * scale) / scale).otherwise(half_away(v / down) * down)).otherwise(v)


def cast_to(v: Val, kind: str) -> Val:
    return {"number": num, "text": txt, "bool": truth}[kind](v)


#: Function name to the callable on Vals; the formula compiler looks names up here.
FUNCTIONS: dict[str, Callable[..., Val]] = {}


def function(name: str, params: str, kind: str, *, finite: bool = False, once: bool = False) -> Callable:
    """Register a scalar worksheet function.

    params names each argument's coercion: n number, i number truncated, s text, b logical,
    v as it is; ``n=0.1`` gives the value of an argument left out. The body gets columns (Vals
    for v) and returns the result, or (result, [(condition, error code), ...]): errors of
    arguments come first, then the first condition that holds. ``once`` binds the arguments
    (which must be columns), for bodies that use them often; a condition of None then stands
    for a null result, which is made once.
    """
    specs = params.split()

    def wrap(body: Callable) -> Callable[..., Val]:
        least = sum("=" not in p for p in specs)

        def call(*args: object) -> Val:
            if not least <= len(args) <= len(specs):
                return error(VALUE)
            given = [*args, *[_default(p) for p in specs[len(args) :]]]
            if once:
                raw = [as_val(x) for x in given]

                def checked(*columns: Column) -> Column:
                    *columns, err = columns if fails else (*columns, None)
                    out = body(*columns)
                    value, checks = out if isinstance(out, tuple) else (out, [])
                    before = first_error(err, *[F.when(condition, F.lit(code)) for condition, code in checks if condition is not None])
                    empty = [code for condition, code in checks if condition is None]

                    def judged(v: Column) -> Column:
                        after = [F.when(v.isNull(), F.lit(code)) for code in empty]
                        after += [F.when(F.isnan(v) | (F.abs(v) == math.inf), F.lit(NUM))] if finite else []
                        own = first_error(before, *after)
                        own = F.lit(None).cast("string") if own is None else own
                        return F.struct(F.when(own.isNull(), v).alias("v"), own.alias("e"))

                    return bind([value if before is None else F.when(before.isNull(), value)], judged)

                def coerced(*t: Column) -> Column:
                    vals = [_coerce(p[0], x.unpacked(c)) for p, x, c in zip(specs, raw, t, strict=True)]
                    err = first_error(*[x.e for x in vals])
                    fails.extend([] if err is None else [True])
                    columns = [*[x.v for x in vals], *([] if err is None else [err])]
                    plain_ = all(x.kind in ("number", "blank", "bool") and p[0] in "nib" for p, x in zip(specs, raw, strict=True))
                    return checked(*columns) if plain_ else bind(columns, checked)  # text takes some work to be a number

                # an argument's own struct is bound, so that nested calls do not repeat it
                fails: list[bool] = []
                made = bind([x.packed() for x in raw], coerced)
                return Val(kind, made["v"], made["e"], made, HEAVY + 1)
            vals = [_coerce(p[0], x) for p, x in zip(specs, given, strict=True)]
            err = first_error(*[x.e for x in vals])
            out = body(*[x if p[0] == "v" else x.v for p, x in zip(specs, vals, strict=True)])
            value, checks = out if isinstance(out, tuple) else (out, [])
            for condition, code in checks:
                err = first_error(err, F.when(condition, F.lit(code)))
            if finite:
                value = value if err is None else F.when(err.isNull(), value)
                bad = bind([value], lambda v: F.isnan(v) | (F.abs(v) == math.inf))
                err = first_error(err, F.when(bad, F.lit(NUM)))
            return guarded(kind, value, err)

        call.__name__, call.__doc__ = name.lower().replace(".", "_"), body.__doc__
        FUNCTIONS[name] = call
        return call

    return wrap


def _default(param: str) -> object:
    raw = param.split("=", 1)[1]
    return raw[1:-1] if raw[:1] == "'" else None if raw == "" else raw == "TRUE" if raw in ("TRUE", "FALSE") else float(raw)


def _coerce(code: str, x: object) -> Val:
    if code == "v":
        return as_val(x)
    if code == "i":
        n = num(x)
        return Val("number", trunc0(n.v), n.e)
    return {"n": num, "s": txt, "b": truth}[code](x)
