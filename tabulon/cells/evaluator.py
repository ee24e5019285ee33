"""Evaluation of formulas over one workbook."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from tabulon.cells import values as V
from tabulon.cells.values import CALC, CIRCULAR, DIV0, NAME, NULL, NUM, REF, VALUE, Err, Fail
from tabulon.plans.parser import FormulaError, Node, Ref, parse, parse_cell, parse_ref

#: Cells deeper than this in one formula's own recursion do not occur; Python needs the room.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

#: The largest grid, rows and columns.
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384


class _Omitted:
    """What an argument slot that was left out binds."""


OMITTED = _Omitted()


@dataclass
class Lambda:
    names: list[str]
    body: Node
    scope: dict[str, object]


@dataclass
class Sheet:
    name: str
    values: dict[tuple[int, int], object] = field(default_factory=dict)
    formulas: dict[tuple[int, int], str] = field(default_factory=dict)


@dataclass
class Workbook:
    sheets: list[Sheet] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)

    def sheet(self, name: str | None) -> Sheet | None:
        if name is None:
            return self.sheets[0] if self.sheets else None
        return next((s for s in self.sheets if s.name.lower() == name.lower()), None)


#: Function name to its implementation on (evaluator, argument nodes).
FORMS: dict[str, Callable[[Evaluator, list[Node]], object]] = {}


def form(*names: str) -> Callable:
    """Register a function that looks at its argument nodes itself."""

    def wrap(body: Callable) -> Callable:
        for name in names:
            FORMS[name] = body
        return body

    return wrap


def scalar(name: str, params: str = "", *, context: bool = False) -> Callable:
    """Register a function of scalar arguments.

    params names each argument's coercion: n number, i number truncated, s text, b logical, v
    the value as it is, errors too; ``n=0.1`` gives the value of an argument left out, and with
    ``?`` also that of an empty slot.
    """
    specs = params.split()
    least = sum("=" not in p for p in specs)

    def wrap(body: Callable) -> Callable:
        def call(ev: Evaluator, nodes: list[Node]) -> object:
            if not least <= len(nodes) <= len(specs):
                raise Fail(VALUE)
            given: list[object] = [ev] if context else []
            for k, spec in enumerate(specs):
                if k >= len(nodes) or "?" in spec and nodes[k].kind == "missing":
                    raw = spec.split("=", 1)[1]
                    given.append({"TRUE": True, "FALSE": False, "": None}[raw] if raw in ("TRUE", "FALSE", "") else float(raw))
                else:
                    given.append(coerce(spec[0], ev.scalar(nodes[k])))
            return body(*given)

        call.__doc__ = body.__doc__
        FORMS[name] = call
        return body

    return wrap


def coerce(code: str, x: object) -> object:
    if code == "v":
        return x
    if code == "i":
        n = V.num(x)
        return float(math.trunc(n)) if math.isfinite(n) else n
    return {"n": V.num, "s": V.txt, "b": V.truth}[code](x)


class Evaluator:
    """One workbook, the sheet and cell that a formula is at, and the names bound so far."""

    def __init__(self, book: Workbook, sheet: str | None = None, host: tuple[int, int] = (0, 0), *, date_1904: bool = False, dynamic: bool = False, seed: int | None = None) -> None:
        self.book, self.host = book, host
        self.sheet = sheet or (book.sheets[0].name if book.sheets else "Sheet1")
        self.offset = 1462 if date_1904 else 0
        self.dynamic, self.seed = dynamic, seed
        self.scope: dict[str, object] = {}
        self.visiting: set[tuple[str, int, int]] = set()
        self.known: dict[tuple[str, int, int], object] = {}
        self.cycles = 0
        self.trees: dict[str, Node] = {}

    # entries

    def formula(self, text: str) -> object:
        """The value of a formula; in scalar mode a bare range is met by the formula's own cell."""
        tree = self.trees.get(text)
        if tree is None:
            tree = self.trees[text] = parse(text)
        self.prepare(tree)
        if tree.kind == "ref" and not tree.value.single and not self.dynamic:
            return self.scalar(tree)
        return self.value(tree)

    def cell(self, sheet: str | None, row: int, column: int) -> object:
        held = self.book.sheet(sheet or self.sheet)
        if held is None:
            return Err(REF) if self.book.sheets or (sheet or "sheet1").lower() != "sheet1" else None  # without sheets all cells are blank
        text = held.formulas.get((row, column))
        if text is None:
            return held.values.get((row, column))
        key = (held.name, row, column)
        if key in self.visiting:
            self.cycles += 1
            return Err(CIRCULAR)
        if key in self.known:
            return self.known[key]
        self.visiting.add(key)
        before, was, scope = self.cycles, (self.sheet, self.host), self.scope
        self.sheet, self.host, self.scope = held.name, (row, column), {}
        try:
            found = self.formula(text)
        finally:
            (self.sheet, self.host), self.scope = was, scope
            self.visiting.discard(key)
        if self.cycles == before:
            self.known[key] = found  # what met a cycle depends on where the visit began
        return found

    def named(self, name: str) -> object:
        refers = self.book.names.get(name.lower())
        if refers is None:
            return Err(NAME)
        refers = refers.strip()
        if not refers.startswith("="):
            try:
                ref = parse_ref(refers)
            except FormulaError:
                pass
            else:
                return self.cell(ref.sheet, ref.top, ref.left) if ref.single and ":" not in refers else self.range(ref)
        return self.formula(refers)

    # what a tree refers to is evaluated first, so that long chains of cells need no deep recursion

    def _references(self, tree: Node) -> Iterator[Ref]:
        if tree.kind == "ref":
            yield tree.value
        for p in tree.parts:
            yield from self._references(p)

    def _pending(self, tree: Node, sheet: str) -> list[tuple[str, int, int]]:
        out = []
        for ref in self._references(tree):
            held = self.book.sheet(ref.sheet or sheet)
            if held is None or not held.formulas:
                continue
            area = (ref.bottom - ref.top + 1) * (ref.right - ref.left + 1)
            if area <= len(held.formulas):
                spots = ((r, c) for r in range(ref.top, ref.bottom + 1) for c in range(ref.left, ref.right + 1) if (r, c) in held.formulas)
            else:
                spots = (k for k in held.formulas if ref.top <= k[0] <= ref.bottom and ref.left <= k[1] <= ref.right)
            out += [(held.name, *k) for k in spots if (held.name, *k) not in self.known]
        return out

    def prepare(self, tree: Node) -> None:
        """Evaluate the cells that a tree refers to, those that they refer to first."""
        if self.visiting:
            return  # cells are only prepared from outside
        todo, seen = [(key, False) for key in self._pending(tree, self.sheet)], set()
        while todo:
            key, ready = todo.pop()
            if key in self.known or not ready and key in seen:
                continue
            seen.add(key)
            if ready:
                self.cell(*key)
                continue
            text = self.book.sheet(key[0]).formulas[key[1:]]
            try:
                inner = self.trees.get(text) or parse(text)
            except FormulaError:
                continue
            self.trees[text] = inner
            todo.append((key, True))
            todo += [(k, False) for k in self._pending(inner, key[0]) if k not in seen]

    def range(self, ref: Ref) -> object:
        return [[self.cell(ref.sheet, r, c) for c in range(ref.left, ref.right + 1)] for r in range(ref.top, ref.bottom + 1)]

    # trees

    def value(self, node: Node) -> object:
        """Any value, arrays whole; a function that is not applied is #CALC!."""
        got = self._value(node)
        return Err(CALC) if isinstance(got, Lambda) else None if got is OMITTED else got

    def scalar(self, node: Node) -> object:
        """One value: a range by implicit intersection, an array by its first cell."""
        if node.kind == "ref" and not node.value.single and not self.dynamic:
            spot = self._met(node.value)
            return Err(VALUE) if spot is None else V.top_left(self.cell(node.value.sheet, *spot))
        return V.top_left(self.value(node))

    def _met(self, ref: Ref) -> tuple[int, int] | None:
        row, column = self.host
        in_rows, in_columns = ref.top <= row <= ref.bottom, ref.left <= column <= ref.right
        if ref.left == ref.right:
            return (row, ref.left) if in_rows else None
        if ref.top == ref.bottom:
            return (ref.top, column) if in_columns else None
        return (row, column) if in_rows and in_columns else None

    def _value(self, node: Node) -> object:
        try:
            return getattr(self, "_" + node.kind)(node)
        except Fail as fail:
            return fail.code

    def _number(self, node: Node) -> object:
        return node.value

    _text = _number

    def _error(self, node: Node) -> object:
        return Err(node.value)

    def _missing(self, node: Node) -> object:
        return None

    def _ref(self, node: Node) -> object:
        ref = node.value
        return self.cell(ref.sheet, ref.top, ref.left) if ref.single else self.range(ref)

    def _meet(self, node: Node) -> object:
        ref = self.meeting(node)
        return self.cell(ref.sheet, ref.top, ref.left) if ref.single else self.range(ref)

    def meeting(self, node: Node) -> Ref:
        """The rectangle that a reference, or an intersection of references, stands for."""
        if node.kind == "ref":
            return node.value
        if node.kind != "meet":
            raise Fail(VALUE)
        a, b = (self.meeting(p) for p in node.parts)
        if a.sheet and b.sheet and a.sheet.lower() != b.sheet.lower():
            raise Fail(NULL)
        out = Ref(a.sheet or b.sheet, max(a.top, b.top), max(a.left, b.left), min(a.bottom, b.bottom), min(a.right, b.right))
        if out.top > out.bottom or out.left > out.right:
            raise Fail(NULL)
        return out

    def is_reference(self, node: Node) -> bool:
        """Whether values come from cells: a reference, or a defined name that no LET or LAMBDA binds."""
        if node.kind == "name":
            return str(node.value).lower() not in self.scope and str(node.value).lower() not in ("true", "false")
        return node.kind in ("ref", "meet")

    def _name(self, node: Node) -> object:
        key = str(node.value).lower()
        if key in self.scope:
            return self.scope[key]
        if key in ("true", "false"):
            return key == "true"
        return self.named(key)

    def _array(self, node: Node) -> object:
        return [[self.value(c) for c in row.parts] for row in node.parts]

    def _sign(self, node: Node) -> object:
        n = V.num(self.scalar(node.parts[0]))
        return -n if node.value == "-" else n

    def _percent(self, node: Node) -> object:
        return V.num(self.scalar(node.parts[0])) / 100

    def _binary(self, node: Node) -> object:
        a, b = (self.scalar(p) for p in node.parts)
        return operate(str(node.value), V.checked(a), V.checked(b))

    def _apply(self, node: Node) -> object:
        return self.apply_nodes(self.function(node.parts[0]), node.parts[1:])

    def _call(self, node: Node) -> object:
        name = str(node.value)
        held = self.scope.get(name.lower())
        if isinstance(held, Lambda):
            return self.apply_nodes(held, node.parts)
        if name in FORMS:
            return FORMS[name](self, node.parts)
        if name.lower() in self.book.names:
            made = self.function(Node("name", name))
            if made is not None:
                return self.apply_nodes(made, node.parts)
        raise Fail(NAME)

    # functions as values

    def function(self, node: Node) -> Lambda | None:
        """The LAMBDA that a node writes or names."""
        if node.kind == "call" and node.value == "LAMBDA":
            return make_lambda(self, node.parts)
        if node.kind == "name":
            key = str(node.value).lower()
            if key in self.scope:
                got = self.scope[key]
            elif key in self.book.names:
                tree = parse(self.book.names[key])
                got = self.function(tree) if tree.kind in ("call", "name") else None
            else:
                got = None
            return got if isinstance(got, Lambda) else None
        got = self._value(node) if node.kind in ("call", "apply") else None
        if isinstance(got, Err):
            raise Fail(got)
        return got if isinstance(got, Lambda) else None

    def apply_nodes(self, function: Lambda | None, nodes: list[Node]) -> object:
        if function is None or len(nodes) > len(function.names):
            raise Fail(VALUE)
        given = [OMITTED if n.kind == "missing" else self._value(n) for n in nodes]
        return self.apply(function, [*given, *[OMITTED] * (len(function.names) - len(given))])

    def apply(self, function: Lambda, given: list[object]) -> object:
        was = self.scope
        self.scope = function.scope | dict(zip(function.names, given, strict=True))
        try:
            return self._value(function.body)
        finally:
            self.scope = was


def make_lambda(ev: Evaluator, nodes: list[Node]) -> Lambda:
    if not nodes or any(n.kind != "name" for n in nodes[:-1]):
        raise Fail(VALUE)
    names = [str(n.value).lower() for n in nodes[:-1]]
    if len(set(names)) < len(names):
        raise Fail(VALUE)
    return Lambda(names, nodes[-1], ev.scope)


def power(a: float, b: float) -> float:
    if a == 0 and b == 0 or a < 0 and b != math.floor(b):
        raise Fail(NUM)
    try:
        n = math.pow(a, b)
    except (OverflowError, ValueError):
        raise Fail(NUM) from None
    if not math.isfinite(n):
        raise Fail(NUM)
    return n


def divide(a: float, b: float) -> float:
    if b == 0:
        raise Fail(DIV0)
    return a / b


_ARITHMETIC: dict[str, Callable[[float, float], float]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "^": power}
_COMPARISON: dict[str, Callable[[object, object], bool]] = {
    "=": V.same, "<>": lambda a, b: not V.same(a, b), "<": lambda a, b: V.order(a, b) < 0, ">": lambda a, b: V.order(a, b) > 0,
    "<=": lambda a, b: V.order(a, b) <= 0, ">=": lambda a, b: V.order(a, b) >= 0,
}


def operate(op: str, a: object, b: object) -> object:
    if op == "&":
        return V.txt(a) + V.txt(b)
    if op in _COMPARISON:
        return _COMPARISON[op](a, b)
    return _ARITHMETIC[op](V.num(a), V.num(b))


def at_cell(text: str | None) -> tuple[str | None, tuple[int, int]]:
    """Sheet and cell of a place such as Sheet1!B2."""
    if not text:
        return None, (0, 0)
    sheet, _, cell = text.rpartition("!")
    return sheet.strip("'") or None, parse_cell(cell)
