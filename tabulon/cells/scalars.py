"""Scalar functions on cell values: operators' helpers, math, information, dates and text."""

from __future__ import annotations

import datetime
import math
import re

from tabulon.cells import values as V
from tabulon.cells.evaluator import FORMS, Evaluator, divide, form, power, scalar
from tabulon.cells.values import DIV0, NA, NUM, VALUE, Err, Fail
from tabulon.functions.logic import ERROR_NUMBERS
from tabulon.functions.text import CELL_UNITS, WINDOWS_1252
from tabulon.plans.parser import Node

# ---------------------------------------------------------------- math


def _scaled(n: float, digits: float, to_whole) -> float:
    """sign(n) * to_whole(|n| * 10^digits) / 10^digits, dividing by 10^-digits where it is negative."""
    if n == 0 or abs(digits) > 308:
        return n if digits > 0 else 0.0
    p = 10.0 ** abs(digits)
    x = abs(n) * p if digits >= 0 else abs(n) / p
    if not math.isfinite(x):
        return n
    whole = to_whole(x)
    return math.copysign(whole / p if digits >= 0 else whole * p, n)


def _floor(x: float) -> float:
    return float(math.floor(x)) if abs(x) < 2**53 else x


def _ceil(x: float) -> float:
    return float(math.ceil(x)) if abs(x) < 2**53 else x


def _snap(x: float) -> float:
    whole = V.half_away(x)
    return whole if abs(x - whole) <= abs(x) * 1e-14 + 1e-14 else x


def _snap_half(x: float) -> float:
    twice = V.half_away(2 * x)
    return twice / 2 if abs(2 * x - twice) <= 2 * (abs(x) * 1e-14 + 1e-14) else x


def int_down(n: float) -> float:
    """Down, but up over a gap that is a rounding error."""
    below = _floor(n)
    gap = below + 1 - n
    return below + 1 if below != n and gap < 0.5 and gap <= 5e-15 * max(abs(below + 1), 1.0) else below


def _multiple(n: float, step: float, up: bool) -> float:
    if n == int(n) and step == int(step) and max(abs(n), abs(step)) <= 2**53:
        q, r = divmod(int(n), int(step))
        return float((q + (up and r != 0)) * int(step))
    q = n / step
    near = V.half_away(q)
    if abs(q - near) <= 5e-15 * max(abs(near), 1.0):
        return V.r15(step * near)
    return step * (_ceil(q) if up else _floor(q))


def _to_step(n: float, step: float, up: bool) -> float:
    if n > 0 and step < 0:
        raise Fail(NUM)
    if step == 0:
        if n == 0:
            return 0.0
        raise Fail(DIV0)
    return int_down(n) if step == 1 and not up else _multiple(n, step, up)


def _to_step_math(n: float, step: float, mode: float, up: bool) -> float:
    if step == 0:
        return 0.0
    turned = n < 0 and mode != 0
    return _multiple(n, abs(step), up != turned)


def _mod(n: float, d: float) -> float:
    q = divide(n, d)
    return n - d * _floor(q)


def _root(n: float) -> float:
    if n < 0:
        raise Fail(NUM)
    return math.sqrt(n)


scalar("ABS", "n")(abs)
scalar("SIGN", "n")(lambda n: float((n > 0) - (n < 0)))
scalar("INT", "n")(int_down)
scalar("TRUNC", "n i=0")(lambda n, d: _scaled(n, d, _floor))
scalar("ROUND", "n i?=0")(lambda n, d: _scaled(n, d, lambda x: _floor(_snap_half(x) + 0.5)))
scalar("ROUNDUP", "n i=0")(lambda n, d: _scaled(n, d, lambda x: _ceil(_snap(x))))
scalar("ROUNDDOWN", "n i?=0")(lambda n, d: _scaled(n, d, lambda x: _floor(_snap(x))))
scalar("FLOOR", "n n")(lambda n, s: _to_step(n, s, False))
scalar("CEILING", "n n")(lambda n, s: _to_step(n, s, True))
scalar("FLOOR.MATH", "n n=1 n=0")(lambda n, s, m: _to_step_math(n, s, m, False))
scalar("CEILING.MATH", "n n=1 n=0")(lambda n, s, m: _to_step_math(n, s, m, True))
scalar("MOD", "n n")(_mod)
scalar("SQRT", "n")(_root)
scalar("POWER", "n n")(power)
scalar("PI")(lambda: math.pi)
scalar("ISEVEN", "i")(lambda n: n % 2 == 0)
scalar("ISODD", "i")(lambda n: n % 2 != 0)
scalar("TRUE")(lambda: True)
scalar("FALSE")(lambda: False)
scalar("NA")(lambda: Err(NA))
scalar("NOT", "b")(lambda b: not b)


@form("N")
def _n(ev: Evaluator, nodes: list[Node]) -> object:
    if len(nodes) != 1:
        raise Fail(VALUE)
    x = ev.value(nodes[0])
    return V.checked(x) if isinstance(x, float | Err) else 1.0 if x is True else 0.0


# ---------------------------------------------------------------- information

scalar("ISBLANK", "v")(lambda x: x is None)
scalar("ISNUMBER", "v")(lambda x: isinstance(x, float))
scalar("ISTEXT", "v")(V.is_text)
scalar("ISLOGICAL", "v")(lambda x: isinstance(x, bool))
scalar("ISNONTEXT", "v")(lambda x: not V.is_text(x))
scalar("ISERROR", "v")(lambda x: isinstance(x, Err))
scalar("ISERR", "v")(lambda x: isinstance(x, Err) and x != NA)
scalar("ISNA", "v")(lambda x: isinstance(x, Err) and x == NA)


@form("TYPE")
def _type(ev: Evaluator, nodes: list[Node]) -> object:
    if len(nodes) != 1:
        raise Fail(VALUE)
    x = ev.value(nodes[0])
    return 64.0 if isinstance(x, list) else 16.0 if isinstance(x, Err) else 4.0 if isinstance(x, bool) else 2.0 if isinstance(x, str) else 1.0


@scalar("ERROR.TYPE", "v")
def _error_type(x: object) -> object:
    if not isinstance(x, Err) or str(x) not in ERROR_NUMBERS:
        raise Fail(NA)
    return float(ERROR_NUMBERS[str(x)])


# ---------------------------------------------------------------- dates

LAST = 2958465
_ORIGIN = datetime.date(1899, 12, 30).toordinal()


def month_start(y: int, m: int) -> int:
    """Serial of the first day of a month, which may be out of 1 to 12; years out of range fail."""
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    if not 1 <= y <= 9999:
        raise Fail(NUM)
    s = datetime.date(y, m, 1).toordinal() - _ORIGIN
    return s if s >= 61 else s - 1


def month_days(y: int, m: int) -> int:
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    return 31 if m == 12 else month_start(y, m + 1) - month_start(y, m)


def whole_serial(ev: Evaluator, n: float) -> int:
    """The day of a date argument in the 1900 system."""
    if not math.isfinite(n):
        raise Fail(NUM)
    s = math.floor(n) + ev.offset
    if n < 0 or s > LAST:
        raise Fail(NUM)
    return s


def civil(s: int) -> tuple[int, int, int]:
    if s in (0, 60):
        return (1900, 1, 0) if s == 0 else (1900, 2, 29)
    d = datetime.date.fromordinal(_ORIGIN + (s if s > 60 else s + 1))
    return d.year, d.month, d.day


def given_serial(ev: Evaluator, s: int) -> float:
    if not 0 <= s <= LAST or s < ev.offset:
        raise Fail(NUM)
    return float(s - ev.offset)


def _months(n: float) -> int:
    if not abs(n) < 1e6:
        raise Fail(NUM)
    return int(n)


def _moved(y: int, m: int) -> int:
    """The first of a month that is not before 1900."""
    if y + (m - 1) // 12 < 1900:
        raise Fail(NUM)
    return month_start(y, m)


@scalar("DATE", "i i i", context=True)
def _date(ev, y, m, d):
    if not 0 <= y <= 9999 or not max(abs(m), abs(d)) < 1e7:
        raise Fail(NUM)
    first = month_start(int(y) + (1900 if y < 1900 else 0), int(m))
    return given_serial(ev, first + int(d) - 1)


@scalar("TIME", "i i i")
def _time(h, m, s):
    total = h * 3600 + m * 60 + s
    if total < 0 or not max(h, m, s) <= 32767:
        raise Fail(NUM)
    return total % 86400 / 86400


scalar("YEAR", "n", context=True)(lambda ev, n: float(civil(whole_serial(ev, n))[0]))
scalar("MONTH", "n", context=True)(lambda ev, n: float(civil(whole_serial(ev, n))[1]))
scalar("DAY", "n", context=True)(lambda ev, n: float(civil(whole_serial(ev, n))[2]))


@scalar("EDATE", "n i", context=True)
def _edate(ev, n, months):
    y, m, d = civil(whole_serial(ev, n))
    return given_serial(ev, _moved(y, m + _months(months)) + min(d, month_days(y, m + _months(months))) - 1)


@scalar("EOMONTH", "n i", context=True)
def _eomonth(ev, n, months):
    y, m, _ = civil(whole_serial(ev, n))
    return given_serial(ev, _moved(y, m + _months(months)) + month_days(y, m + _months(months)) - 1)


@scalar("WEEKDAY", "n i=1", context=True)
def _weekday(ev, n, kind):
    s = whole_serial(ev, n)
    if kind == 3:
        return float((s - 2) % 7)
    start = {1: 1, 2: 2}.get(kind, kind - 9 if 11 <= kind <= 17 else None)
    if start is None:
        raise Fail(NUM)
    return float((s - start) % 7 + 1)


def _iso_week(s: int) -> float:
    if s <= 1:
        return 52.0
    thursday = max(s - (s - 2) % 7 + 3, 0)
    return float((thursday - month_start(civil(thursday)[0], 1)) // 7 + 1) if thursday <= LAST else 52.0


@scalar("WEEKNUM", "n i=1", context=True)
def _weeknum(ev, n, kind):
    s = whole_serial(ev, n)
    if kind == 21:
        return _iso_week(s)
    start = {1: 1, 2: 2, 17: 1, 11: 2}.get(kind, kind - 9 if 12 <= kind <= 16 else None)
    if start is None:
        raise Fail(NUM)
    first = month_start(civil(s)[0], 1)
    return float((s - first + (first - start) % 7) // 7 + 1)


scalar("ISOWEEKNUM", "n", context=True)(lambda ev, n: _iso_week(whole_serial(ev, n)))


def _workdays(weekend: object, one_sided: bool) -> list[int]:
    """Working days as serial mod 7 (0 is Saturday)."""
    if V.is_text(weekend):
        if len(weekend) != 7 or set(weekend) - {"0", "1"} or one_sided and weekend == "1111111":
            raise Fail(VALUE)
        off = {(k + 2) % 7 for k, c in enumerate(weekend) if c == "1"}
    else:
        code = math.trunc(V.num(weekend))
        if 1 <= code <= 7:
            off = {(code + 6) % 7, code % 7}
        elif 11 <= code <= 17:
            off = {(code - 10) % 7}
        else:
            raise Fail(NUM)
    return [k for k in range(7) if k not in off]


def _through(n: int, work: list[int]) -> int:
    """Working days among the serials 0 to n."""
    weeks, rest = divmod(n + 1, 7)
    return len(work) * weeks + sum(w < rest for w in work)


def _nth(w: int, work: list[int]) -> int:
    """The serial of the w-th working day from serial 0 on."""
    weeks, rest = divmod(w - 1, len(work))
    return 7 * weeks + work[rest]


def _holidays(ev: Evaluator, node: Node | None, work: list[int]) -> list[int]:
    if node is None:
        return []
    days = set()
    for x in V.flat(ev.value(node)):
        V.checked(x)
        if x is None:
            continue
        s = whole_serial(ev, V.num(x))
        if s % 7 in work:
            days.add(s)
    return sorted(days)


def _networkdays(ev: Evaluator, nodes: list[Node], weekend: Node | None, days_off: Node | None) -> float:
    a, b = (whole_serial(ev, V.num(ev.scalar(n))) for n in nodes[:2])
    work = _workdays(V.checked(ev.scalar(weekend)) if weekend else 1.0, False)
    off = _holidays(ev, days_off, work)
    low, high = min(a, b), max(a, b)
    n = _through(high, work) - _through(low - 1, work) - sum(low <= h <= high for h in off)
    return float(-n if a > b else n)


def _workday(ev: Evaluator, nodes: list[Node], weekend: Node | None, days_off: Node | None) -> float:
    s = whole_serial(ev, V.num(ev.scalar(nodes[0])))
    n = V.num(ev.scalar(nodes[1]))
    if not abs(n) < 1e8:
        raise Fail(NUM)
    n = math.trunc(n)
    work = _workdays(V.checked(ev.scalar(weekend)) if weekend else 1.0, True)
    off = _holidays(ev, days_off, work)
    if n == 0:
        return given_serial(ev, s)
    extra = -1
    met = 0
    while met != extra:  # holidays on the way move the day on, which may pass further holidays
        extra = met
        if n > 0:
            found = _nth(_through(s, work) + n + extra, work)
            met = sum(s < h <= found for h in off)
        else:
            found = _nth(_through(s - 1, work) + n - extra + 1, work)
            met = sum(found <= h < s for h in off)
    return given_serial(ev, found)


def _with_calendar(name: str, body, weekend_at: int | None, holidays_at: int) -> None:
    def call(ev: Evaluator, nodes: list[Node]) -> object:
        if not 2 <= len(nodes) <= holidays_at + 1:
            raise Fail(VALUE)
        pick = lambda k: nodes[k] if k is not None and len(nodes) > k and nodes[k].kind != "missing" else None
        return body(ev, nodes, pick(weekend_at), pick(holidays_at))

    FORMS[name] = call


_with_calendar("NETWORKDAYS", _networkdays, None, 2)
_with_calendar("NETWORKDAYS.INTL", _networkdays, 2, 3)
_with_calendar("WORKDAY", _workday, None, 2)
_with_calendar("WORKDAY.INTL", _workday, 2, 3)


def _february_end(y: int, m: int, d: int) -> bool:
    return m == 2 and d == month_days(y, 2)


def _thirty(y1, m1, d1, y2, m2, d2) -> int:
    return (y2 - y1) * 360 + (m2 - m1) * 30 + d2 - d1


@scalar("DAYS360", "n n b=FALSE", context=True)
def _days360(ev, a, b, european):
    (y1, m1, d1), (y2, m2, d2) = civil(whole_serial(ev, a)), civil(whole_serial(ev, b))
    if european:
        return float(_thirty(y1, m1, min(d1, 30), y2, m2, min(d2, 30)))
    start = 30 if d1 == 31 or _february_end(y1, m1, d1) else d1
    return float(_thirty(y1, m1, start, y2, m2, 30 if d2 == 31 and start >= 30 else d2))


def _leap(y: int) -> bool:
    return y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) or y == 1900


@scalar("YEARFRAC", "n n i=0", context=True)
def _yearfrac(ev, start, end, basis):
    a, b = sorted((whole_serial(ev, start), whole_serial(ev, end)))
    if not 0 <= basis <= 4:
        raise Fail(NUM)
    (y1, m1, d1), (y2, m2, d2) = civil(a), civil(b)
    if basis in (2, 3):
        return (b - a) / (360 if basis == 2 else 365)
    if basis == 4:
        return _thirty(y1, m1, min(d1, 30), y2, m2, min(d2, 30)) / 360
    if basis == 0:
        if d1 == 31:
            d1, d2 = 30, 30 if d2 == 31 else d2
        elif d1 == 30 and d2 == 31:
            d2 = 30
        elif _february_end(y1, m1, d1):
            d1, d2 = 30, 30 if _february_end(y2, m2, d2) else d2
        return _thirty(y1, m1, d1, y2, m2, d2) / 360
    if y1 == y2 or y2 == y1 + 1 and (m1, d1) >= (m2, d2):
        leap = _leap(y1) if y1 == y2 else _leap(y1) and a <= month_start(y1, 3) - 1 or _leap(y2) and b >= month_start(y2, 3) - 1
        return (b - a) / (366 if leap else 365)
    span = month_start(y2, 13) - month_start(y1, 1) if y2 < 9999 else LAST + 1 - month_start(y1, 1)
    return (b - a) * (y2 - y1 + 1) / span


# ---------------------------------------------------------------- text


def _count(n: float, least: float = 0) -> int:
    if n < least:
        raise Fail(VALUE)
    return int(min(n, 1 << 31))


def fit(t: str) -> str:
    """A text that a cell holds; longer ones are #VALUE!."""
    if len(t) > CELL_UNITS // 2 and len(t.encode("utf-16-le", "surrogatepass")) // 2 > CELL_UNITS:
        raise Fail(VALUE)
    return t


scalar("LEN", "s")(lambda t: float(len(t)))
scalar("LEFT", "s i?=1")(lambda t, n: t[: _count(n)])
scalar("RIGHT", "s i=1")(lambda t, n: t[max(len(t) - _count(n), 0) :])
scalar("MID", "s i i")(lambda t, start, n: t[_count(start, 1) - 1 : _count(start, 1) - 1 + _count(n)])
scalar("LOWER", "s")(str.lower)
scalar("UPPER", "s")(lambda t: "ß".join(part.upper() for part in t.split("ß")))
scalar("TRIM", "s")(lambda t: re.sub(" +", " ", t).strip(" "))
scalar("CLEAN", "s")(lambda t: re.sub(r"[\x00-\x1f]", "", t))
scalar("EXACT", "s s")(lambda a, b: a == b)
scalar("PROPER", "s")(lambda t: re.sub("[A-Za-z]+", lambda m: m[0][0].upper() + m[0][1:].lower(), t))


@scalar("FIND", "s s i?=1")
def _find(needle, hay, start):
    if not 1 <= start <= len(hay) + 1:
        raise Fail(VALUE)
    at = hay.find(needle, int(start) - 1)
    if at < 0:
        raise Fail(VALUE)
    return float(at + 1)


def wild(pattern: str, any_one: str = ".", any_run: str = ".*") -> str:
    """A regular expression for * (any run), ? (one character) and ~ (the next one as it is)."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "~" and k + 1 < len(pattern) and pattern[k + 1] in "*?~":
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append({"*": any_run, "?": any_one}.get(c) or re.escape(c))
        k += 1
    return "".join(out)


@scalar("SEARCH", "s s i?=1")
def _search(pattern, hay, start):
    if not 1 <= start <= len(hay):
        raise Fail(VALUE)
    m = re.compile(wild(pattern, any_run=".*?"), re.I | re.S).search(hay, int(start) - 1)
    if m is None:
        raise Fail(VALUE)
    return float(m.start() + 1)


@scalar("SUBSTITUTE", "s s s i=")
def _substitute(t, old, new, instance):
    if instance is not None and instance < 1:
        raise Fail(VALUE)
    if old == "" or instance is None:
        return fit(t if old == "" else t.replace(old, new))
    parts = t.split(old)
    k = int(min(instance, 1 << 31))
    return fit(t if len(parts) <= k else old.join(parts[:k]) + new + old.join(parts[k:]))


@scalar("REPLACE", "s i i s")
def _replace(t, start, n, new):
    at = _count(start, 1) - 1
    return fit(t[:at] + new + t[at + _count(n) :])


@scalar("REPT", "s i")
def _rept(t, n):
    if n < 0 or n * max(len(t), 1) > 2 * CELL_UNITS and t:
        raise Fail(VALUE)
    return fit(t * int(n)) if t else ""


@scalar("CHAR", "i")
def _char(n):
    if not 1 <= n <= 255:
        raise Fail(VALUE)
    n = int(n)
    found = WINDOWS_1252[n - 128] if 128 <= n < 160 else chr(n)
    return chr(n) if found is None else found


@scalar("CODE", "s")
def _code(t):
    if not t:
        raise Fail(VALUE)
    if t[0] in WINDOWS_1252:
        return float(128 + WINDOWS_1252.index(t[0]))
    if ord(t[0]) > 255:
        raise Fail(VALUE)
    return float(ord(t[0]))


@scalar("UNICODE", "s")
def _unicode(t):
    if not t:
        raise Fail(VALUE)
    return float(ord(t[0]))


@scalar("UNICHAR", "i")
def _unichar(n):
    if 0xD800 <= n <= 0xDFFF:
        raise Fail(NA)
    if not 1 <= n <= 0x10FFFF:
        raise Fail(VALUE)
    return chr(int(n))


def _texts(ev: Evaluator, nodes: list[Node]) -> list[str]:
    from tabulon.cells.arrays import in_array_context

    return [V.txt(x) for n in nodes for x in V.flat(in_array_context(ev, n))]


@form("CONCAT")
def _concat(ev: Evaluator, nodes: list[Node]) -> object:
    if not nodes:
        raise Fail(VALUE)
    return fit("".join(_texts(ev, nodes)))


@form("TEXTJOIN")
def _textjoin(ev: Evaluator, nodes: list[Node]) -> object:
    if len(nodes) < 3:
        raise Fail(VALUE)
    marks = _texts(ev, nodes[:1]) or [""]
    skip = V.truth(ev.scalar(nodes[1]))
    words = [w for w in _texts(ev, nodes[2:]) if w or not skip]
    return fit("".join(w if k == 0 else marks[(k - 1) % len(marks)] + w for k, w in enumerate(words)))


def _delimiters(ev: Evaluator, node: Node) -> list[str]:
    return [V.txt(x) for x in V.flat(ev.value(node))]


def _around(ev: Evaluator, nodes: list[Node], after: bool) -> object:
    if not 2 <= len(nodes) <= 6:
        raise Fail(VALUE)
    t = V.txt(ev.scalar(nodes[0]))
    given = _delimiters(ev, nodes[1])
    option = lambda k, code, default: coerce_option(ev, nodes, k, code, default)
    place = option(2, "n", 1.0)
    k = math.trunc(place) if math.isfinite(place) else 0
    mode, at_end = option(3, "n", 0.0), option(4, "n", 0.0)
    if not after and (mode not in (0, 1) or at_end not in (0, 1)):
        raise Fail(VALUE)
    if not after and t == "" and k:
        return ""
    if k == 0 or abs(k) > len(t):
        raise Fail(VALUE)
    useful = [d for d in given if d]
    if not useful if after else len(useful) < len(given):
        return (t if k > 0 else "") if after else ("" if k > 0 else t)
    if not after:
        useful.sort(key=len, reverse=True)
    hits = [(m.start(), m.end()) for m in re.finditer("|".join(map(re.escape, useful)), t, re.I if mode else 0)]
    if at_end:
        hits = hits + [(len(t), len(t))] if k > 0 else [(0, 0)] + hits
    if abs(k) > len(hits):
        if len(nodes) > 5 and nodes[5].kind != "missing":
            return ev.scalar(nodes[5])
        raise Fail(NA)
    start, end = hits[k - 1 if k > 0 else k]
    return t[end:] if after else t[:start]


def coerce_option(ev: Evaluator, nodes: list[Node], k: int, code: str, default: object) -> object:
    from tabulon.cells.evaluator import coerce

    return coerce(code, ev.scalar(nodes[k])) if len(nodes) > k and nodes[k].kind != "missing" else default


form("TEXTAFTER")(lambda ev, nodes: _around(ev, nodes, True))
form("TEXTBEFORE")(lambda ev, nodes: _around(ev, nodes, False))


@form("TEXTSPLIT")
def _textsplit(ev: Evaluator, nodes: list[Node]) -> object:
    if not 2 <= len(nodes) <= 6:
        raise Fail(VALUE)
    t = V.txt(ev.scalar(nodes[0]))
    present = lambda k: len(nodes) > k and nodes[k].kind != "missing"
    columns, rows = (_delimiters(ev, nodes[k]) if present(k) else None for k in (1, 2))
    if columns is None and rows is None or "" in (columns or []) or "" in (rows or []):
        raise Fail(VALUE)
    skip, mode = coerce_option(ev, nodes, 3, "b", False), coerce_option(ev, nodes, 4, "n", 0.0)
    if mode not in (0, 1):
        raise Fail(VALUE)
    pad = ev.scalar(nodes[5]) if present(5) else Err(NA)

    def cut(x: str, marks: list[str] | None) -> list[str]:
        if marks is None:
            return [x]
        parts = re.split("|".join(re.escape(d) for d in sorted(marks, key=len, reverse=True)), x, flags=re.I if mode else 0)
        return [p for p in parts if p] if skip else parts

    lines = [cut(line, columns) for line in cut(t, rows)]
    lines = [line for line in lines if line]
    if not lines:
        raise Fail(V.CALC)
    wide = max(map(len, lines))
    return [[*line, *[pad] * (wide - len(line))] for line in lines]


_CLOCK = re.compile(r"(\d{1,4}):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?(?:\s*([AaPp])[Mm]?)?")
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _clock(t: str) -> float | None:
    m = _CLOCK.fullmatch(t)
    if m is None:
        return None
    h, minute, second = int(m[1]), int(m[2]), float(m[3] or 0)
    if minute > 59 or second >= 60 or m[4] and not 1 <= h <= 12:
        return None
    if m[4]:
        h = h % 12 + (12 if m[4] in "pP" else 0)
    return (h * 3600 + minute * 60 + second) / 86400


def _day_text(ev: Evaluator, t: str) -> float | None:
    m = re.fullmatch(r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})", t)
    if m:
        y, month, d = int(m[1]), int(m[3]), int(m[4])
    elif m := re.fullmatch(r"(\d{1,2})([-/])(\d{1,2})\2(\d{4}|\d{2})", t):
        y, month, d = int(m[4]), int(m[1]), int(m[3])
        y += (2000 if y < 30 else 1900) if len(m[4]) == 2 else 0
    elif m := re.fullmatch(r"(\d{1,2})[- ]([A-Za-z]{3,9})[- ,]+(\d{4}|\d{2})", t):
        y, month, d = int(m[3]), next((k + 1 for k, n in enumerate(_MONTHS) if m[2].lower().startswith(n)), 0), int(m[1])
        y += (2000 if y < 30 else 1900) if len(m[3]) == 2 else 0
    elif m := re.fullmatch(r"([A-Za-z]{3,9}) (\d{1,2}),? (\d{4})", t):
        y, month, d = int(m[3]), next((k + 1 for k, n in enumerate(_MONTHS) if m[1].lower().startswith(n)), 0), int(m[2])
    else:
        return None
    if not 1900 <= y <= 9999 or not 1 <= month <= 12 or not 1 <= d <= month_days(y, month):
        return None
    return float(month_start(y, month) + d - 1 - ev.offset)


def text_value(ev: Evaluator, t: str) -> float | None:
    """Separators, currency, percent, brackets, exponents, dates, times, mixed fractions."""
    t = t.strip()
    if m := re.fullmatch(r"([+-]?)(?:(\d+) +)?(\d+)/(\d+)", t):
        if m[2] is not None and int(m[4]):
            return (int(m[2]) + int(m[3]) / int(m[4])) * (-1 if m[1] == "-" else 1)
    if (c := _clock(t)) is not None:
        return c
    if (d := _day_text(ev, t)) is not None:
        return d
    first, _, rest = t.partition(" ")
    if rest and (d := _day_text(ev, first)) is not None and (c := _clock(rest.strip())) is not None:
        return d + c
    body, scale = t, 1.0
    if body.startswith("(") and body.endswith(")"):
        body, scale = body[1:-1].strip(), -1.0
        if body[:1] in "+-":
            return None
    share = len(body) - len(body.rstrip("%"))
    body = body.rstrip("%").strip() if share else body
    sign = ""
    if body[:1] in ("+", "-"):
        sign, body = body[0], body[1:].strip()
    if body.startswith("$"):
        body = body[1:].strip()
        if not sign and body[:1] in ("+", "-"):
            sign, body = body[0], body[1:]
    elif body.endswith("$"):
        return None
    if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d*)?([eE][+-]?\d+)?", body):
        body = body.replace(",", "")
    if not re.fullmatch(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", body):
        return None
    n = float(sign + body) * scale / 100.0**share
    return n if math.isfinite(n) else None


@scalar("VALUE", "v", context=True)
def _value(ev, x):
    V.checked(x)
    if not isinstance(x, str):
        return V.num(x)
    n = text_value(ev, x)
    if n is None:
        raise Fail(VALUE)
    return n


_NUMBER_FORMAT = re.compile(r'(?P<head>(?:[$ ()€£+-]|\\.|"[^"]*")*)(?P<whole>[#0,]+)?(?:\.(?P<part>[0#]*))?(?P<share>%*)(?P<tail>(?:[ ()$€£%-]|\\.|"[^"]*")*)')
_DATE_TOKENS = re.compile(r'y+|m+|d+|[-/., :]|"[^"]*"|\\.', re.I)


def _literal(s: str) -> str:
    return "".join(x[1:] if x[0] == "\\" else x.strip('"') for x in re.findall(r'"[^"]*"|\\.|.', s))


def format_number(n: float, m: re.Match) -> str:
    whole, part, share = m["whole"] or "", m["part"] or "", len(m["share"])
    places = len(part)
    scaled = V.r15(abs(n)) * 100.0**share
    if whole.endswith(","):
        drop = len(whole) - len(whole.rstrip(","))
        scaled, whole = scaled / 1000.0**drop, whole.rstrip(",")
    rounded = math.floor(scaled * 10.0**places + 0.5) if scaled * 10.0**places < 2**53 else int(scaled * 10.0**places)
    left, right = divmod(int(rounded), 10**places)
    digits = str(left).rjust(whole.count("0"), "0") if left or whole.count("0") else ""
    if "," in whole:
        digits = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", digits)
    tail = str(right).rjust(places, "0") if places else ""
    keep = part.rfind("0") + 1
    while len(tail) > keep and tail.endswith("0"):
        tail = tail[:-1]
    sign = "-" if n < 0 and rounded else ""
    point = "." if m["part"] is not None else ""
    return sign + _literal(m["head"]) + digits + point + tail + "%" * share + _literal(m["tail"])


def format_date(ev: Evaluator, n: float, tokens: list[str]) -> str:
    s = whole_serial(ev, n)
    y, month, d = civil(s)
    name = datetime.date(2000, month, 1)
    day = datetime.date(2000, 1, 1 + s % 7)  # 1 January 2000 was a Saturday, and so is serial 0
    out = []
    for t in tokens:
        size, kind = len(t), t[0].lower()
        if kind == "y":
            out.append(f"{y % 100:02d}" if size <= 2 else f"{y:04d}")
        elif kind == "m":
            out.append({1: str(month), 2: f"{month:02d}", 3: name.strftime("%b"), 5: name.strftime("%B")[0]}.get(size, name.strftime("%B")))
        elif kind == "d":
            out.append({1: str(d), 2: f"{d:02d}", 3: day.strftime("%a")}.get(size, day.strftime("%A")))
        else:
            out.append(_literal(t))
    return "".join(out)


@scalar("TEXT", "v s", context=True)
def _text(ev, x, pattern):
    V.checked(x)
    if pattern == "":
        return ""
    if pattern.lower() == "general" or pattern == "@":
        return V.txt(x)
    if isinstance(x, bool):
        return V.txt(x)
    n = V.numeric_text(x) if isinstance(x, str) else V.num(x)
    m = _NUMBER_FORMAT.fullmatch(pattern)
    tokens = _DATE_TOKENS.findall(pattern)
    if m and (m["whole"] or m["part"]):
        return x if n is None else format_number(n, m)
    if "".join(tokens) == pattern and any(t[0] in "yYmMdD" for t in tokens) and not any(":" in t for t in tokens):
        return x if n is None else format_date(ev, n, tokens)
    raise Fail(VALUE)
