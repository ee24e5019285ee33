"""Functions of ranges and arrays: aggregates, criteria, control flow, look-ups, reshaping, LAMBDA forms."""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
from collections.abc import Callable, Iterator

from tabulon.cells import values as V
from tabulon.cells.evaluator import FORMS, MAX_COLUMNS, MAX_ROWS, OMITTED, Evaluator, Lambda, form, make_lambda, operate
from tabulon.cells.scalars import wild
from tabulon.cells.values import CALC, DIV0, NA, NAME, NUM, REF, VALUE, Err, Fail
from tabulon.plans.parser import Node, Ref

Grid = list[list[object]]


def arity(nodes: list[Node], least: int, most: int | None = None) -> None:
    if len(nodes) < least or most is not None and len(nodes) > most:
        raise Fail(VALUE)


def given(nodes: list[Node], k: int) -> bool:
    """Whether an argument is there; an empty slot counts."""
    return len(nodes) > k


# ---------------------------------------------------------------- array context


def in_array_context(ev: Evaluator, node: Node) -> object:
    """A value with operators applied cell by cell."""
    if node.kind == "binary":
        return _zipped(str(node.value), *[in_array_context(ev, p) for p in node.parts])
    if node.kind in ("sign", "percent"):
        x = in_array_context(ev, node.parts[0])
        one = (lambda c: -V.num(c)) if node.value == "-" else V.num if node.kind == "sign" else lambda c: V.num(c) / 100
        return [[_guard(one, c) for c in row] for row in x] if isinstance(x, list) else _guard(one, x)
    return ev.value(node)


def _guard(f: Callable, *args: object) -> object:
    try:
        return f(*[V.checked(a) for a in args])
    except Fail as fail:
        return fail.code


def _zipped(op: str, a: object, b: object) -> object:
    f = functools.partial(operate, op)
    if not isinstance(a, list) and not isinstance(b, list):
        return _guard(f, a, b)
    x, y = V.grid(a), V.grid(b)
    (h, w), (h2, w2) = V.shape(x), V.shape(y)
    if (h, w) == (1, 1):
        return [[_guard(f, x[0][0], c) for c in row] for row in y]
    if (h2, w2) == (1, 1):
        return [[_guard(f, c, y[0][0]) for c in row] for row in x]
    if (h, w) != (h2, w2):
        raise Fail(VALUE)
    return [[_guard(f, p, q) for p, q in zip(r, s, strict=True)] for r, s in zip(x, y, strict=True)]


# ---------------------------------------------------------------- aggregates


def _numbers(ev: Evaluator, nodes: list[Node], *, errors: bool = True) -> Iterator[float]:
    """Numbers of ranges and arrays; scalars given directly are coerced."""
    for node in nodes:
        x = ev.value(node)
        if isinstance(x, list) or ev.is_reference(node):
            for c in V.flat(x):
                if errors:
                    V.checked(c)
                if isinstance(c, float):
                    yield c
        elif isinstance(x, Err):
            if errors:
                raise Fail(x)
        elif x is not None:
            if errors or not V.is_text(x) or V.numeric_text(x) is not None:
                yield V.num(x)


def _over_numbers(name: str, f: Callable[[list[float]], float]) -> None:
    FORMS[name] = lambda ev, nodes: f(list(_numbers(ev, nodes)))


def _average(x: list[float]) -> float:
    if not x:
        raise Fail(DIV0)
    return sum(x) / len(x)


_over_numbers("SUM", lambda x: functools.reduce(lambda a, b: a + b, x, 0.0))
_over_numbers("PRODUCT", lambda x: math.prod(x) if x else 0.0)
_over_numbers("AVERAGE", _average)
_over_numbers("MIN", lambda x: min(x, default=0.0))
_over_numbers("MAX", lambda x: max(x, default=0.0))
FORMS["COUNT"] = lambda ev, nodes: float(sum(1 for _ in _numbers(ev, nodes, errors=False)))
FORMS["COUNTA"] = lambda ev, nodes: float(sum(c is not None for n in nodes for c in V.flat(ev.value(n))))
FORMS["COUNTBLANK"] = lambda ev, nodes: float(sum(c is None or c == "" for n in nodes for c in V.flat(ev.value(n))))


@form("SUMPRODUCT")
def _sumproduct(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 1)
    grids = [V.grid(in_array_context(ev, n)) for n in nodes]
    for g in grids:
        for c in V.flat(g):
            V.checked(c)
    if len({V.shape(g) for g in grids}) > 1:
        raise Fail(VALUE)
    total = 0.0
    for row in zip(*grids, strict=True):
        for cells in zip(*row, strict=True):
            total += math.prod(c if isinstance(c, float) else 0.0 for c in cells)
    return total


# ---------------------------------------------------------------- criteria

_ERRORS = re.compile(r"#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|CALC!|SPILL!|GETTING_DATA|CIRCULAR!)")


def _wildcard(pattern: str) -> Callable[[str], bool]:
    """Whole-text match, A-Z without case, byte by byte."""
    body = wild(V.fold(pattern), any_one="\x00", any_run="\x01").encode().replace(b"\x00", b".").replace(b"\x01", b".*")
    matches = re.compile(body, re.S).fullmatch
    return lambda t: matches(V.fold(t).encode()) is not None


def _relation(op: str, c: int) -> bool:
    return {"=": c == 0, "<>": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]


def criterion(x: object, counting: bool) -> Callable[[object], bool]:
    """The test of a criterion value; counting picks the dialect of the COUNTIF family."""
    if isinstance(x, Err):
        if not counting:
            raise Fail(x)
        return lambda c: c == x and isinstance(c, Err)
    if isinstance(x, bool):
        return lambda c: c is x
    if isinstance(x, float):
        return lambda c: isinstance(c, float) and V.same_number(c, x) or counting and V.is_text(c) and (n := V.numeric_text(c)) is not None and V.same_number(n, x)
    if x is None:
        return lambda c: c is None or c == ""
    op = next((o for o in ("<=", ">=", "<>", "<", ">", "=") if x.startswith(o)), "")
    rest, op = x[len(op) :], op or "="
    equality = op in ("=", "<>")

    def positive(c: object) -> bool | None:
        """Whether c equals the operand; for < and the like, None."""
        if rest == "":
            return c is None or not isinstance(c, Err) and c == ""
        if (n := V.numeric_text(rest)) is not None:
            m = c if isinstance(c, float) else V.numeric_text(c) if V.is_text(c) else None
            return m is not None and V.same_number(m, n)
        if counting and rest.upper() in ("TRUE", "FALSE"):
            return c is (rest.upper() == "TRUE")
        if _ERRORS.fullmatch(rest.upper()):
            return str(c).upper() == rest.upper() if isinstance(c, str) else False
        return V.is_text(c) and hit(c)

    hit = _wildcard(rest) if re.search("[*?~]", rest) else lambda t: V.fold(t) == V.fold(rest)
    if equality:
        code = bool(_ERRORS.fullmatch(rest.upper()))

        def test(c: object) -> bool:
            if counting and isinstance(c, Err) and not code:
                return False
            return positive(c) == (op == "=")

        return test
    if rest == "":
        return lambda c: False
    if (n := V.numeric_text(rest)) is not None:
        return lambda c: isinstance(c, float) and _relation(op, 0 if V.same_number(c, n) else -1 if c < n else 1)
    low = V.fold(rest)
    return lambda c: V.is_text(c) and not re.search("[*?~]", rest) and _relation(op, (V.fold(c) > low) - (V.fold(c) < low))


def _area(ev: Evaluator, node: Node, arrays: bool = False) -> Grid:
    """The cells of a range; computed arrays only where they are allowed."""
    if ev.is_reference(node):
        x = ev.value(node)
        if isinstance(x, Err) and node.kind == "name":
            raise Fail(x)
        return V.grid(x)
    if not arrays:
        raise Fail(VALUE)
    return V.grid(ev.value(node))


def _same_shape(grids: list[Grid]) -> None:
    if len({V.shape(g) for g in grids}) > 1:
        raise Fail(VALUE)


def _matching(ev: Evaluator, pairs: list[Node], counting: bool) -> tuple[list[Grid], Callable[[int, int], bool]]:
    grids = [_area(ev, n) for n in pairs[::2]]
    tests = [criterion(ev.scalar(n), counting) for n in pairs[1::2]]
    return grids, lambda r, c: all(test(g[r][c]) for g, test in zip(grids, tests, strict=True))


def _picked(values: Grid, test: Callable[[int, int], bool]) -> list[float]:
    out = []
    for r, row in enumerate(values):
        for c, x in enumerate(row):
            if test(r, c) and isinstance(V.checked(x), float):
                out.append(x)
    return out


def _one_criterion(ev: Evaluator, nodes: list[Node], blank_is_zero: bool) -> list[float]:
    arity(nodes, 2, 3)
    tested = _area(ev, nodes[0])
    wanted = ev.scalar(nodes[1])
    test = criterion(0.0 if blank_is_zero and wanted is None else wanted, False)
    values = tested
    if len(nodes) == 3:
        _area(ev, nodes[2])
        ref = ev.meeting(nodes[2]) if nodes[2].kind in ("ref", "meet") else None
        if ref is not None:  # as large as the tested range, from its own first cell
            h, w = V.shape(tested)
            values = V.grid(ev.range(Ref(ref.sheet, ref.top, ref.left, ref.top + h - 1, ref.left + w - 1)))
        else:
            values = _area(ev, nodes[2])
            _same_shape([tested, values])
    return _picked(values, lambda r, c: test(tested[r][c]))


def _many_criteria(ev: Evaluator, nodes: list[Node]) -> list[float]:
    arity(nodes, 3)
    if len(nodes) % 2 == 0:
        raise Fail(VALUE)
    values = _area(ev, nodes[0])
    grids, test = _matching(ev, nodes[1:], False)
    _same_shape([values, *grids])
    return _picked(values, test)


FORMS["SUMIF"] = lambda ev, nodes: math.fsum(_one_criterion(ev, nodes, False))
FORMS["AVERAGEIF"] = lambda ev, nodes: _average(_one_criterion(ev, nodes, True))
FORMS["SUMIFS"] = lambda ev, nodes: math.fsum(_many_criteria(ev, nodes))
FORMS["AVERAGEIFS"] = lambda ev, nodes: _average(_many_criteria(ev, nodes))


@form("COUNTIF")
def _countif(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 2)
    test = criterion(ev.scalar(nodes[1]), True)
    return float(sum(map(test, V.flat(ev.value(nodes[0])))))


@form("COUNTIFS")
def _countifs(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2)
    if len(nodes) % 2:
        raise Fail(VALUE)
    grids, test = _matching(ev, nodes, True)
    _same_shape(grids)
    h, w = V.shape(grids[0])
    return float(sum(test(r, c) for r in range(h) for c in range(w)))


# ---------------------------------------------------------------- control flow


@form("IF")
def _if(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 1, 3)
    holds = V.truth(ev.scalar(nodes[0]))
    if len(nodes) == 1:
        return holds
    return ev.value(nodes[1]) if holds else ev.value(nodes[2]) if len(nodes) > 2 else False


@form("IFS")
def _ifs(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2)
    if len(nodes) % 2:
        raise Fail(VALUE)
    chosen: object = Err(NA)
    done = False
    first: Err | None = None
    for condition, value in zip(nodes[::2], nodes[1::2], strict=True):
        test, found = ev.scalar(condition), ev.value(value)
        try:
            holds = V.truth(test)
        except Fail as fail:
            first, holds = first or fail.code, False
        if isinstance(found, Err):
            first = first or found
        if holds and not done:
            chosen, done = found, True
    return first or chosen


@form("IFERROR")
def _iferror(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 2)
    x = ev.value(nodes[0])
    return ev.value(nodes[1]) if isinstance(x, Err) else x


@form("IFNA")
def _ifna(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 2)
    x = ev.value(nodes[0])
    return ev.value(nodes[1]) if isinstance(x, Err) and x == NA else x


@form("SWITCH")
def _switch(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 3)
    key = V.checked(ev.scalar(nodes[0]))
    for value, result in zip(nodes[1::2], nodes[2::2], strict=False):
        if V.same(key, V.checked(ev.scalar(value))):
            return ev.value(result)
    return ev.value(nodes[-1]) if len(nodes) % 2 == 0 else Err(NA)


def _logicals(ev: Evaluator, nodes: list[Node]) -> list[bool]:
    arity(nodes, 1)
    out = []
    for node in nodes:
        for c in V.flat(ev.value(node)):
            if c is not None:
                out.append(V.truth(c))
    return out


FORMS["AND"] = lambda ev, nodes: all(_logicals(ev, nodes))
FORMS["OR"] = lambda ev, nodes: any(_logicals(ev, nodes))
FORMS["XOR"] = lambda ev, nodes: sum(_logicals(ev, nodes)) % 2 == 1


@form("CHOOSE")
def _choose(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2)
    k = V.num(ev.scalar(nodes[0]))
    if not 1 <= k < len(nodes):
        raise Fail(VALUE)
    return ev.value(nodes[int(k)])


# ---------------------------------------------------------------- look-ups


def key_test(key: object) -> Callable[[object], bool]:
    """Exact match of a look-up key: the = operator, or wildcards where the key is a text that has some."""
    if V.is_text(key) and re.search("[*?~]", key):
        matches = _wildcard(key)
        return lambda c: not isinstance(c, Err) and matches(V.txt(c))
    return lambda c: not isinstance(c, Err) and V.same(key, c)


def _compare(a: object, b: object) -> int:
    return V.order(None if isinstance(a, Err) else a, b) if not isinstance(a, Err) else 1


def upper_bound(keys: list[object], key: object) -> int | None:
    """Place of the last key that is not above, by halving, as if the keys were sorted."""
    at = bisect.bisect_right(keys, 0, key=lambda c: _compare(c, key))
    return at - 1 if at else None


def _place(keys: list[object], key: object, nearest: bool) -> int:
    found = upper_bound(keys, key) if nearest else next((k for k, c in enumerate(keys) if test(c)), None) if (test := key_test(key)) else None
    if found is None:
        raise Fail(NA)
    return found


def _table_lookup(ev: Evaluator, nodes: list[Node], down: bool) -> object:
    arity(nodes, 3, 4)
    key = V.checked(ev.scalar(nodes[0]))
    table = V.grid(ev.value(nodes[1]))
    at = V.num(ev.scalar(nodes[2]))
    nearest = V.truth(ev.scalar(nodes[3])) if given(nodes, 3) else True
    if at < 1:
        raise Fail(VALUE)
    table = table if down else [list(c) for c in zip(*table, strict=True)]
    if not table:
        raise Fail(NA)
    if at >= len(table[0]) + 1:
        raise Fail(REF)
    return table[_place([row[0] for row in table], key, nearest)][int(at) - 1]


form("VLOOKUP")(lambda ev, nodes: _table_lookup(ev, nodes, True))
form("HLOOKUP")(lambda ev, nodes: _table_lookup(ev, nodes, False))


def vector(g: Grid) -> list[object]:
    return list(g[0]) if len(g) == 1 else [row[0] for row in g]


@form("MATCH")
def _match(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 3)
    key = V.checked(ev.scalar(nodes[0]))
    keys = vector(V.grid(ev.value(nodes[1])))
    kind = V.num(ev.scalar(nodes[2])) if given(nodes, 2) else 1.0
    if kind >= 0:
        return float(_place(keys, key, kind > 0) + 1)
    for k, c in enumerate(keys):
        if _compare(c, key) >= 0:
            return float(k + 1)
    raise Fail(NA)


@form("INDEX")
def _index(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 1, 3)
    g = V.grid(ev.value(nodes[0]))
    h, w = V.shape(g)
    row = V.num(ev.scalar(nodes[1])) if given(nodes, 1) else 1.0
    column = V.num(ev.scalar(nodes[2])) if given(nodes, 2) else 1.0
    if len(nodes) == 2 and h == 1:
        row, column = 1.0, row
    if not 1 <= row < h + 1 or not 1 <= column < w + 1:
        raise Fail(REF)
    return g[int(row) - 1][int(column) - 1]


@form("XLOOKUP")
def _xlookup(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 3, 6)
    key = V.checked(ev.scalar(nodes[0]))
    keys, back = V.grid(ev.value(nodes[1])), V.grid(ev.value(nodes[2]))
    other = ev.value(nodes[3]) if given(nodes, 3) and nodes[3].kind != "missing" else Err(NA)
    mode, way = (math.trunc(V.num(ev.scalar(nodes[k]))) if given(nodes, k) else default for k, default in ((4, 0), (5, 1)))
    if mode not in (-1, 0, 1, 2) or way not in (-2, -1, 1, 2) or mode == 2 and abs(way) == 2:
        raise Fail(VALUE)
    (h, w), (rows, columns) = V.shape(keys), V.shape(back)
    if w == 1 and rows == h:
        column, answers = [r[0] for r in keys], [r[0] if columns == 1 else [list(r)] for r in back]
    elif h == 1 and columns == w:
        column, answers = list(keys[0]), [back[0][c] if rows == 1 else [[r[c]] for r in back] for c in range(w)]
    else:
        raise Fail(VALUE)
    at = find_key(key, column, mode, way)
    return other if at is None else answers[at]


def _same_kind(key: object, c: object) -> bool:
    """Equal and of one type: XLOOKUP does not take TRUE for 1, nor a blank for 0."""
    return V.rank(key) == V.rank(c) and (key is None) == (c is None) and V.same(key, c)


def find_key(key: object, keys: list[object], mode: int, way: int) -> int | None:
    places = range(len(keys)) if way > 0 else range(len(keys) - 1, -1, -1)
    if mode == 2:
        matches = _wildcard(key) if V.is_text(key) else None
        return next((k for k in places if (matches(keys[k]) if matches and V.is_text(keys[k]) else _same_kind(key, keys[k]))), None)
    if abs(way) == 2:  # halving over keys that should rise (or fall)
        sign = 1 if way == 2 else -1
        at = bisect.bisect_left(keys, 0, key=lambda c: sign * _compare(c, key))
        if at < len(keys) and _same_kind(key, keys[at]):
            return at
        near = at - 1 if mode == -sign else at if mode == sign else None
        return near if near is not None and 0 <= near < len(keys) else None
    best: int | None = None
    for k in places:
        c = keys[k]
        if isinstance(c, Err):
            continue
        if _same_kind(key, c):
            return k
        if mode and c is not None and _compare(c, key) == mode and (best is None or V.order(c, keys[best]) == -mode):
            best = k
    return best


# ---------------------------------------------------------------- reshaping


def whole(x: object) -> int:
    n = V.num(x)
    if not math.isfinite(n):
        raise Fail(NUM)
    return math.trunc(n)


def array_of(ev: Evaluator, node: Node) -> Grid:
    """A rectangle; an error given directly ends the function."""
    x = ev.value(node)
    if isinstance(x, list):
        w = V.shape(x)[1]
        if any(len(r) != w for r in x):
            raise Fail(VALUE)
        return x
    return [[V.checked(x)]]


def turned(g: Grid) -> Grid:
    return [list(c) for c in zip(*g, strict=True)]


def not_empty(g: Grid) -> Grid:
    if not g or not g[0]:
        raise Fail(CALC)
    return g


def capped(rows: int, columns: int) -> None:
    if rows > MAX_ROWS or columns > MAX_COLUMNS:
        raise Fail(NUM)


@form("FILTER")
def _filter(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 3)
    g = array_of(ev, nodes[0])
    include = V.grid(ev.value(nodes[1]))
    keep = [V.truth(c) for c in V.flat(include)]
    (h, w), (ih, iw) = V.shape(g), V.shape(include)
    if (ih, iw) == (1, 1):
        found = g if keep[0] else []
    elif iw == 1 and ih == h:
        found = [r for r, k in zip(g, keep, strict=True) if k]
    elif ih == 1 and iw == w:
        found = [[c for c, k in zip(r, keep, strict=True) if k] for r in g]
    else:
        raise Fail(VALUE)
    if not found or not found[0]:
        if not given(nodes, 2) or nodes[2].kind == "missing":
            raise Fail(CALC)
        return ev.value(nodes[2])
    return found


def sort_key(descending: bool) -> Callable[[object], tuple]:
    def compare(a: object, b: object) -> int:
        """Numbers, texts, logicals, errors, all turned round when descending; blanks are last either way."""
        if a is None or b is None:
            return (a is None) - (b is None)
        ra, rb = V.rank(a), V.rank(b)
        if ra != rb:
            c = -1 if ra < rb else 1
        elif ra == 3:
            c = 0
        elif ra == 0:
            x, y = V.r15(a), V.r15(b)
            c = (x > y) - (x < y)
        else:
            c = V.order(a, b)
        return -c if descending else c

    return functools.cmp_to_key(compare)


def _direction(x: object) -> bool:
    n = whole(x)
    if n not in (1, -1):
        raise Fail(VALUE)
    return n == -1


@form("SORT")
def _sort(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 1, 4)
    g = array_of(ev, nodes[0])
    at = whole(ev.scalar(nodes[1])) if given(nodes, 1) else 1
    key = sort_key(_direction(ev.scalar(nodes[2])) if given(nodes, 2) else False)
    by_column = V.truth(ev.scalar(nodes[3])) if given(nodes, 3) else False
    lines = turned(g) if by_column else g
    if not 1 <= at <= len(lines[0]):
        raise Fail(VALUE)
    lines = sorted(lines, key=lambda line: key(line[at - 1]))
    return turned(lines) if by_column else lines


@form("SORTBY")
def _sortby(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2)
    g = array_of(ev, nodes[0])
    (h, w), lines, by_column = V.shape(g), g, None
    order = list(range(max(h, w)))
    keys = []
    for k in range(1, len(nodes), 2):
        by = array_of(ev, nodes[k])
        down = _direction(ev.scalar(nodes[k + 1])) if given(nodes, k + 1) and nodes[k + 1].kind != "missing" else False
        bh, bw = V.shape(by)
        across = bw == 1 and bh == h
        if not across and not (bh == 1 and bw == w) or by_column not in (None, not across):
            raise Fail(VALUE)
        by_column = not across
        keys.append(([c for c in V.flat(by)], sort_key(down)))
    if len(keys) > 64:
        raise Fail(VALUE)
    lines = turned(g) if by_column else g
    order = list(range(len(lines)))
    for cells, key in reversed(keys):
        order.sort(key=lambda i, cells=cells, key=key: key(cells[i]))
    out = [lines[i] for i in order]
    return turned(out) if by_column else out


def distinct_key(c: object) -> tuple:
    return (V.rank(c), None if c is None else V.r15(c) + 0.0 if isinstance(c, float) else V.fold(c) if V.is_text(c) else c, c is None)


@form("UNIQUE")
def _unique(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 1, 3)
    g = array_of(ev, nodes[0])
    by_column = V.truth(ev.scalar(nodes[1])) if given(nodes, 1) else False
    once = V.truth(ev.scalar(nodes[2])) if given(nodes, 2) else False
    lines = turned(g) if by_column else g
    count: dict[tuple, int] = {}
    first: dict[tuple, list] = {}
    for line in lines:
        key = tuple(map(distinct_key, line))
        count[key] = count.get(key, 0) + 1
        first.setdefault(key, line)
    out = [line for key, line in first.items() if not once or count[key] == 1]
    not_empty(out)
    return turned(out) if by_column else out


def _flattened(ev: Evaluator, nodes: list[Node], strict: bool) -> list[object]:
    arity(nodes, 1, 3)
    x = ev.value(nodes[0])
    g = x if isinstance(x, list) else [[x if ev.is_reference(nodes[0]) else V.checked(x)]]
    skip = V.num(ev.scalar(nodes[1])) if given(nodes, 1) else 0.0
    if strict and skip != math.floor(skip) or not 0 <= math.trunc(skip) <= 3:
        raise Fail(VALUE)
    skip = math.trunc(skip)
    by_column = V.truth(ev.scalar(nodes[2])) if given(nodes, 2) else False
    w = V.shape(g)[1]
    if any(len(r) != w for r in g):
        raise Fail(VALUE)
    cells = [c for row in (turned(g) if by_column else g) for c in row]
    cells = [c for c in cells if not (skip & 1 and c is None) and not (skip & 2 and isinstance(c, Err))]
    if not cells:
        raise Fail(CALC)
    return cells


@form("TOCOL")
def _tocol(ev: Evaluator, nodes: list[Node]) -> object:
    cells = _flattened(ev, nodes, False)
    capped(len(cells), 1)
    return [[c] for c in cells]


@form("TOROW")
def _torow(ev: Evaluator, nodes: list[Node]) -> object:
    cells = _flattened(ev, nodes, True)
    capped(1, len(cells))
    return [cells]


@form("SEQUENCE")
def _sequence(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 1, 4)
    numbers = [V.num(ev.scalar(n)) if n.kind != "missing" else 1.0 for n in nodes] + [1.0] * (4 - len(nodes))
    rows, columns = whole(numbers[0]), whole(numbers[1])
    if rows < 0 or columns < 0:
        raise Fail(VALUE)
    if rows == 0 or columns == 0:
        raise Fail(CALC)
    if rows * columns > 1 << 24:
        raise Fail(VALUE)
    return [[numbers[2] + (r * columns + c) * numbers[3] for c in range(columns)] for r in range(rows)]


def _blocks(ev: Evaluator, nodes: list[Node], errors_stop: bool) -> list[Grid]:
    arity(nodes, 1)
    out = []
    for node in nodes:
        x = ev.value(node)
        if errors_stop and isinstance(x, Err) and not ev.is_reference(node):
            raise Fail(x)
        g = x if isinstance(x, list) else [[x]]
        if g and g[0]:
            w = V.shape(g)[1]
            if any(len(r) != w for r in g):
                raise Fail(VALUE)
            out.append(g)
    if not out:
        raise Fail(CALC)
    return out


@form("VSTACK")
def _vstack(ev: Evaluator, nodes: list[Node]) -> object:
    blocks = _blocks(ev, nodes, True)
    wide = max(V.shape(g)[1] for g in blocks)
    out = [[*row, *[Err(NA)] * (wide - len(row))] for g in blocks for row in g]
    capped(len(out), wide)
    return out


@form("HSTACK")
def _hstack(ev: Evaluator, nodes: list[Node]) -> object:
    blocks = _blocks(ev, nodes, False)
    tall = max(len(g) for g in blocks)
    out = [[c for g in blocks for c in (g[r] if r < len(g) else [Err(NA)] * len(g[0]))] for r in range(tall)]
    capped(tall, len(out[0]))
    return out


def _wrapped(ev: Evaluator, nodes: list[Node], down: bool) -> tuple[list[object], int, object]:
    arity(nodes, 2, 3)
    g = array_of(ev, nodes[0])
    h, w = V.shape(g)
    if h != 1 and w != 1:
        raise Fail(VALUE)
    n = whole(ev.scalar(nodes[1]))
    if n < 1:
        raise Fail(NUM)
    pad = ev.scalar(nodes[2]) if given(nodes, 2) and nodes[2].kind != "missing" else Err(NA)
    cells = list(V.flat(g))
    if not down:
        capped(1, n)
    elif n >= len(cells):
        return cells, len(cells), pad
    return cells + [pad] * (-len(cells) % n), n, pad


@form("WRAPROWS")
def _wraprows(ev: Evaluator, nodes: list[Node]) -> object:
    cells, n, _ = _wrapped(ev, nodes, False)
    capped(len(cells) // n, n)
    return [cells[k : k + n] for k in range(0, len(cells), n)]


@form("WRAPCOLS")
def _wrapcols(ev: Evaluator, nodes: list[Node]) -> object:
    cells, n, _ = _wrapped(ev, nodes, True)
    capped(n, len(cells) // n)
    return [cells[k::n] for k in range(n)]


def _slice(size: int, n: int) -> slice:
    return slice(0, min(n, size)) if n >= 0 else slice(max(size + n, 0), size)


@form("TAKE")
def _take(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 1, 3)
    g = array_of(ev, nodes[0])
    wanted = [whole(ev.scalar(n)) for n in nodes[1:]]
    if 0 in wanted:
        raise Fail(CALC)
    if wanted:
        g = g[_slice(len(g), wanted[0])]
    return [row[_slice(len(row), wanted[1])] for row in g] if len(wanted) > 1 else g


@form("DROP")
def _drop(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 3)
    g = array_of(ev, nodes[0])
    cut = lambda line, n: line[n:] if n >= 0 else line[: len(line) + n] if -n < len(line) else []
    wanted = [whole(ev.scalar(n)) for n in nodes[1:]]
    g = not_empty(cut(g, wanted[0]))
    return not_empty([cut(row, wanted[1]) for row in g]) if len(wanted) > 1 else g


@form("EXPAND")
def _expand(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 4)
    g = array_of(ev, nodes[0])
    size = list(V.shape(g))
    for k in (1, 2):
        x = ev.scalar(nodes[k]) if given(nodes, k) else None
        if x is not None:
            n = whole(x)
            if n < size[k - 1]:
                raise Fail(VALUE)
            size[k - 1] = n
    capped(*size)
    pad = ev.scalar(nodes[3]) if given(nodes, 3) and nodes[3].kind != "missing" else Err(NA)
    return [[*row, *[pad] * (size[1] - len(row))] for row in g] + [[pad] * size[1] for _ in range(size[0] - len(g))]


def _chosen(ev: Evaluator, nodes: list[Node], size: int) -> list[int]:
    out = []
    for node in nodes:
        for x in V.flat(ev.value(node)):
            n = whole(x)
            if n == 0 or abs(n) > size:
                raise Fail(VALUE)
            out.append(n - 1 if n > 0 else size + n)
    return out


@form("CHOOSEROWS")
def _chooserows(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2)
    g = array_of(ev, nodes[0])
    return [g[k] for k in _chosen(ev, nodes[1:], len(g))]


@form("CHOOSECOLS")
def _choosecols(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2)
    g = array_of(ev, nodes[0])
    places = _chosen(ev, nodes[1:], len(g[0]))
    return [[row[k] for k in places] for row in g]


@form("RANDARRAY")
def _randarray(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 0, 5)
    value = lambda k, default: V.num(ev.scalar(nodes[k])) if given(nodes, k) else default
    rows, columns = whole(value(0, 1.0)), whole(value(1, 1.0))
    low, high = value(2, 0.0), value(3, 1.0)
    integers = V.truth(ev.scalar(nodes[4])) if given(nodes, 4) else False
    if rows <= 0 or columns <= 0:
        raise Fail(CALC)
    capped(rows, columns)
    if low > high or integers and (low != math.floor(low) or high != math.floor(high)):
        raise Fail(VALUE)
    source = random.Random(ev.seed)
    draw = (lambda: float(source.randint(int(low), int(high)))) if integers else lambda: low + source.random() * (high - low)
    return [[draw() for _ in range(columns)] for _ in range(rows)]


# ---------------------------------------------------------------- LAMBDA forms

#: Aggregates that BYROW takes by name; BYCOL takes all but COUNTBLANK.
NAMED_AGGREGATES = ("SUM", "PRODUCT", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "COUNTBLANK")


def needed(ev: Evaluator, node: Node, params: int) -> Lambda:
    function = ev.function(node)
    if function is None or len(function.names) != params:
        raise Fail(VALUE)
    return function


def in_cell(x: object) -> object:
    """What a cell of a computed array shows: an array or a function there is #CALC!."""
    if isinstance(x, Lambda):
        return Err(CALC)
    if isinstance(x, list):
        return x[0][0] if V.shape(x) == (1, 1) and not isinstance(x[0][0], list) else Err(CALC)
    return None if x is OMITTED else x


@form("LAMBDA")
def _lambda(ev: Evaluator, nodes: list[Node]) -> object:
    return make_lambda(ev, nodes)


_NAME = re.compile(r"[A-Za-z_\\][A-Za-z0-9_.\\]*")


@form("LET")
def _let(ev: Evaluator, nodes: list[Node]) -> object:
    if len(nodes) < 3 or len(nodes) % 2 == 0 or len(nodes) > 253:
        raise Fail(VALUE)
    was = ev.scope
    ev.scope = dict(was)
    try:
        for key, value in zip(nodes[:-1:2], nodes[1:-1:2], strict=True):
            if key.kind != "name" or str(key.value).lower() in ("r", "c") or not _NAME.fullmatch(str(key.value)) or str(key.value).lower() in ("true", "false"):
                raise Fail(NAME)
            ev.scope[str(key.value).lower()] = ev._value(value)
        return ev._value(nodes[-1])
    finally:
        ev.scope = was


@form("ISOMITTED")
def _isomitted(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 1, 1)
    return nodes[0].kind == "name" and ev.scope.get(str(nodes[0].value).lower()) is OMITTED


@form("MAKEARRAY")
def _makearray(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 3, 3)
    rows, columns = (whole(V.checked(ev.scalar(n))) for n in nodes[:2])
    if rows < 1 or columns < 1:
        raise Fail(VALUE)
    capped(rows, columns)
    function = needed(ev, nodes[2], 2)
    return [[in_cell(ev.apply(function, [float(r + 1), float(c + 1)])) for c in range(columns)] for r in range(rows)]


@form("MAP")
def _map(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2)
    grids = [V.grid(V.checked(ev.value(n))) for n in nodes[:-1]]
    function = needed(ev, nodes[-1], len(grids))
    shapes = [V.shape(g) for g in grids]
    h, w = max(s[0] for s in shapes), max(s[1] for s in shapes)
    if h == 0 or w == 0:
        raise Fail(CALC)
    out = []
    for r in range(h):
        row = []
        for c in range(w):
            cells = [g[r][c] if r < len(g) and c < len(g[r]) else OMITTED for g in grids]
            row.append(Err(NA) if any(x is OMITTED for x in cells) else in_cell(ev.apply(function, cells)))
        out.append(row)
    return out


@form("SCAN")
def _scan(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 3)
    nodes = nodes if len(nodes) == 3 else [Node("missing"), *nodes]
    g = V.grid(V.checked(ev.value(nodes[1])))
    function = needed(ev, nodes[2], 2)
    seeded = nodes[0].kind != "missing"
    total = V.checked(ev.value(nodes[0])) if seeded else None
    if isinstance(total, list):
        raise Fail(VALUE)
    out = []
    for row in g:
        line = []
        for c in row:
            total = in_cell(ev.apply(function, [total, c])) if seeded else c
            seeded = True
            line.append(total)
        out.append(line)
    return not_empty(out)


@form("REDUCE")
def _reduce(ev: Evaluator, nodes: list[Node]) -> object:
    arity(nodes, 2, 3)
    nodes = nodes if len(nodes) == 3 else [Node("missing"), *nodes]
    seeded = nodes[0].kind != "missing"
    total = V.checked(ev.value(nodes[0])) if seeded else None
    cells = list(V.flat(V.checked(ev.value(nodes[1]))))
    function = needed(ev, nodes[2], 2)
    if not seeded:
        if not cells:
            raise Fail(CALC)
        total, cells = cells[0], cells[1:]
    for c in cells:
        total = ev.apply(function, [total, c])
    return total


def _by_line(ev: Evaluator, nodes: list[Node], lines: Callable[[Grid], Grid], line: Callable[[list], object], named: tuple[str, ...], by_row: bool) -> list[object]:
    arity(nodes, 2, 2)
    g = V.grid(V.checked(ev.value(nodes[0])))
    last = nodes[1]
    key = str(last.value).upper().removeprefix("_XLFN.") if last.kind == "name" else ""
    if key in named and key.lower() not in ev.scope and key.lower() not in ev.book.names:
        held = "\x00line"
        function = Lambda([held], Node("call", key, [Node("name", held)]), ev.scope)
    else:
        function = ev.function(last)
        if function is None and by_row:
            V.checked(ev.value(last))
            raise Fail(CALC)
        if function is None or len(function.names) != 1:
            raise Fail(VALUE)
    return [in_cell(ev.apply(function, [line(x)])) for x in lines(g)]


@form("BYROW")
def _byrow(ev: Evaluator, nodes: list[Node]) -> object:
    return [[x] for x in _by_line(ev, nodes, lambda g: g, lambda row: [row], NAMED_AGGREGATES, True)]


@form("BYCOL")
def _bycol(ev: Evaluator, nodes: list[Node]) -> object:
    return [_by_line(ev, nodes, turned, lambda c: [[x] for x in c], NAMED_AGGREGATES[:-1], False)]
