"""Formula text to one Spark expression over a table's columns.

``compile_formula("=ROUND(price*(1-discount),2)", {"price": number("l_extendedprice"), ...})``
lexes and parses the text and lowers it to a ``Val``. LET and LAMBDA are inlined while the
plan is built; names are case-insensitive; an unknown function is #NAME?.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

import tabulon.functions.dates  # noqa: F401
import tabulon.functions.finance  # noqa: F401
import tabulon.functions.logic as L
import tabulon.functions.math as X
import tabulon.functions.text  # noqa: F401
from tabulon.functions.values import CALC, FUNCTIONS, NAME, REF, VALUE, Val, as_val, error, num, roomy, weighed, with_bound
from tabulon.plans.parser import FormulaError, Node, column_letters, parse

@dataclass
class Lambda:
    names: list[str]
    body: Node
    scope: dict[str, object]


_OMITTED = object()
#: Scope key of a function (name, argument nodes, scope) that is asked before a call is looked up; NotImplemented declines.
CALLS = "\x00calls"
_BINARY = {
    "+": L.add, "-": L.subtract, "*": L.multiply, "/": L.divide, "^": X.power, "&": L.concatenate,
    "=": L.equal, "<>": L.unequal, "<": L.less, ">": L.greater, "<=": L.at_most, ">=": L.at_least,
}


def lower(node: Node, scope: dict[str, object]) -> object:
    if node.kind in ("number", "text"):
        return node.value
    if node.kind == "error":
        return error(str(node.value))
    if node.kind == "missing":
        return None
    if node.kind == "name":
        key = str(node.value).lower()
        if key in ("true", "false"):
            return key == "true"
        found = scope.get(key, error(NAME))
        return None if found is _OMITTED else found
    if node.kind == "ref":  # a name that looks like a cell, such as q1
        ref = node.value
        held = scope.get(f"{column_letters(ref.left)}{ref.top + 1}".lower()) if ref.single and ref.sheet is None else None
        return error(REF) if held is None else None if held is _OMITTED else held
    if node.kind == "array":
        return lower_value(node.parts[0].parts[0], scope) if node.parts[0].parts else error(VALUE)
    if node.kind == "meet":
        return error(REF)
    if node.kind == "sign":
        inner = lower_value(node.parts[0], scope)
        return called(L.negate if node.value == "-" else num, [inner])
    if node.kind == "percent":
        return called(L.percent, [lower_value(node.parts[0], scope)])
    if node.kind == "binary":
        return called(_BINARY[str(node.value)], [lower_value(p, scope) for p in node.parts])
    if node.kind == "apply":
        return _apply(lower(node.parts[0], scope), node.parts[1:], scope)
    return _call(str(node.value), node.parts, scope)


def lower_value(node: Node, scope: dict[str, object]) -> object:
    """A value; a function that is not applied is #CALC!."""
    got = lower(node, scope)
    return error(CALC) if isinstance(got, Lambda) else got


def _apply(function: object, args: list[Node], scope: dict[str, object]) -> object:
    if not isinstance(function, Lambda) or len(args) > len(function.names):
        return error(VALUE)
    given = [_OMITTED if a.kind == "missing" else lower(a, scope) for a in args]
    given += [_OMITTED] * (len(function.names) - len(given))
    return with_bound(given, lambda light: lower(function.body, function.scope | dict(zip(function.names, light, strict=True))))


def _call(name: str, args: list[Node], scope: dict[str, object]) -> object:
    if name == "LAMBDA":
        if not args or any(a.kind != "name" for a in args[:-1]):
            return error(VALUE)
        return Lambda([str(a.value).lower() for a in args[:-1]], args[-1], scope)
    if name == "LET":
        if len(args) % 2 == 0 or len(args) < 3:
            return error(VALUE)
        return _let(args, scope)
    if name == "ISOMITTED":
        if len(args) != 1:
            return error(VALUE)
        return args[0].kind == "name" and scope.get(str(args[0].value).lower()) is _OMITTED
    asked = scope.get(CALLS)
    if asked is not None and (got := asked(name, args, scope)) is not NotImplemented:
        return got
    held = scope.get(name.lower())
    if isinstance(held, Lambda):
        return _apply(held, args, scope)
    if name not in FUNCTIONS:
        return error(NAME)
    try:
        inspect.signature(FUNCTIONS[name]).bind(*args)
    except TypeError:  # too few or too many arguments
        return error(VALUE)
    return called(FUNCTIONS[name], [lower_value(a, scope) for a in args])


def _let(args: list[Node], scope: dict[str, object]) -> object:
    """The first name bound, then the rest."""
    if len(args) == 1:
        return lower(args[0], scope)
    if args[0].kind != "name" or str(args[0].value).lower() in ("r", "c", "true", "false"):  # names that formulas reserve
        return error(NAME)
    return with_bound([lower(args[1], scope)], lambda light: _let(args[2:], scope | {str(args[0].value).lower(): light[0]}))


def called(function: Callable[..., object], args: list[object]) -> object:
    """A function of values; arguments of some weight are computed once, however often it uses them."""
    return with_bound(args, lambda light: weighed(function(*light), *light))


__all__ = ["FormulaError", "compile_formula", "with_formula"]


def compile_formula(text: str, names: dict[str, Val] | None = None) -> Val:
    """The expression of a formula; ``names`` gives the columns it may use."""
    got = lower_value(parse(text), {k.lower(): v for k, v in (names or {}).items()})
    return as_val(got)


def with_formula(frame: DataFrame, out: str, text: str, names: dict[str, Val]) -> DataFrame:
    """The frame with the formula's value and error as columns ``out`` and ``out_error``."""
    roomy(frame.sparkSession)
    made = compile_formula(text, names)
    return frame.withColumns({out: made.v, f"{out}_error": made.error()})
