"""Financial functions on cell values."""

from __future__ import annotations

import math
from collections.abc import Callable

from tabulon.cells import values as V
from tabulon.cells.evaluator import Evaluator, form, scalar
from tabulon.cells.scalars import whole_serial
from tabulon.cells.values import DIV0, NUM, VALUE, Fail
from tabulon.functions.finance import PROBES
from tabulon.plans.parser import Node

#: Newton steps and tolerance of RATE and IRR, and steps of XIRR's solvers.
STEPS, TOLERANCE, LONG_STEPS = 20, 1e-7, 100


def finite(n: float) -> float:
    if not math.isfinite(n):
        raise Fail(NUM)
    return n


def whole_power(a: float, n: int) -> float:
    """a^n by squaring."""
    out, k = 1.0, abs(n)
    while k:
        if k & 1:
            out *= a
        k >>= 1
        if k:
            a *= a
    return out if n >= 0 else 1.0 / out


def growth(rate: float, n: float) -> tuple[float, float]:
    """(1 + rate)^n and that less 1; small rates lose no digits."""
    try:
        if rate <= -1:
            if n != math.floor(n) or rate == -1 and n <= 0:
                raise Fail(NUM)
            g = whole_power(1 + rate, int(n))
            return finite(g), g - 1
        if n == math.floor(n) and abs(rate) >= 1e-5:
            g = whole_power(1 + rate, int(n)) if abs(n) < 2**31 else math.pow(1 + rate, n)
            return finite(g), g - 1
        log = n * math.log1p(rate)
        if abs(log) > 700:
            raise Fail(NUM)
        less = math.expm1(log)
        return 1 + less, less
    except (OverflowError, ValueError, ZeroDivisionError):
        raise Fail(NUM) from None


def due(rate: float, kind: float) -> float:
    return 1 + rate * (1 if kind != 0 else 0)


def pay(rate: float, n: float, pv: float, fv: float, kind: float) -> float:
    if rate == 0:
        if n == 0:
            raise Fail(DIV0)
        return -(pv + fv) / n
    g, less = growth(rate, n)
    below = due(rate, kind) * less
    if below == 0:
        raise Fail(NUM)
    return finite(-(pv * g + fv) * rate / below)


def future(rate: float, n: float, pmt: float, pv: float, kind: float) -> float:
    if rate == 0:
        return -(pv + pmt * n)
    g, less = growth(rate, n)
    return finite(-pv * g - pmt * due(rate, kind) * less / rate)


scalar("PMT", "n n n n=0 n=0")(pay)
scalar("FV", "n n n n=0 n=0")(future)


@scalar("PV", "n n n n=0 n=0")
def _pv(rate, n, pmt, fv, kind):
    if rate == 0:
        return -(fv + pmt * n)
    if rate == -1:
        raise Fail(NUM)
    g, less = growth(rate, n)
    if g == 0:
        raise Fail(NUM)
    return finite(-(fv + pmt * due(rate, kind) * less / rate) / g)


@scalar("NPER", "n n n n=0 n=0")
def _nper(rate, pmt, pv, fv, kind):
    if rate == 0:
        if pmt == 0:
            raise Fail(DIV0)
        return -(pv + fv) / pmt
    below = pmt * due(rate, kind) + pv * rate
    if rate <= -1 or below == 0:
        raise Fail(NUM)
    ratio = -rate * (pv + fv) / below
    if ratio <= -1:
        raise Fail(NUM)
    return finite(math.log1p(ratio) / math.log1p(rate))


def interest(rate, per, n, pv, fv, kind) -> float:
    if per < 1 or per >= n + 1:
        raise Fail(NUM)
    if per == 1 and kind != 0:
        return 0.0
    amount = pay(rate, n, pv, fv, kind)
    if per == 1:
        return -pv * rate
    owed = future(rate, per - 1, amount, pv, kind) * rate
    return finite(owed / (1 + rate) if kind != 0 else owed)


scalar("IPMT", "n n n n n=0 n=0")(interest)
scalar("PPMT", "n n n n n=0 n=0")(lambda rate, per, n, pv, fv, kind: finite(pay(rate, n, pv, fv, kind) - interest(rate, per, n, pv, fv, kind)) if 1 <= per < n + 1 else _num())


def _num() -> float:
    raise Fail(NUM)


def _in_term(rate, n, pv, start, end, kind) -> None:
    if rate <= 0 or n <= 0 or pv <= 0 or start < 1 or end < start or end > n or kind not in (0, 1):
        raise Fail(NUM)


def _paid_interest(rate, n, pv, start, end, kind) -> float:
    """Interest of the periods start to end, as a geometric sum."""
    _in_term(rate, n, pv, start, end, kind)
    if start == end == 1 and kind == 0:
        return -pv * rate
    amount = pay(rate, n, pv, 0.0, kind)
    first = start if kind == 0 else max(start, 2.0)
    count = max(end - first + 1, 0.0)
    if count == 0:
        return 0.0
    before = growth(rate, first - 1 - kind)[0]
    total = before * growth(rate, count)[1] / rate
    return finite(amount * (count - total * (1 + rate if kind else 1)) - total * pv * rate)


def _paid_principal(rate, n, pv, start, end, kind) -> float:
    """Principal of the periods start to end: what the debt falls by, or with payments in advance a geometric sum."""
    _in_term(rate, n, pv, start, end, kind)
    amount = pay(rate, n, pv, 0.0, kind)
    if not kind:
        return finite(future(rate, start - 1, amount, pv, 0) - future(rate, end, amount, pv, 0))
    paid = amount if start == 1 else 0.0  # a payment at the start of the term has no interest
    first = max(start, 1.0 + kind)
    count = max(end - first + 1, 0.0)
    if count:  # each period repays a payment with its rate, less the rate on what was owed before it
        level = amount * (1 + rate) / rate
        owed = count * level - (pv + level) * growth(rate, first - 2)[0] * growth(rate, count)[1] / rate
        paid += count * amount * (1 + rate) - rate * owed
    return finite(paid)


scalar("CUMIPMT", "n i n i i i")(_paid_interest)
scalar("CUMPRINC", "n n n i i i")(_paid_principal)


@scalar("EFFECT", "n i")
def _effect(nominal, n):
    if nominal <= 0 or n < 1:
        raise Fail(NUM)
    return nominal if n == 1 else finite(growth(nominal / n, n)[1])


@scalar("NOMINAL", "n i")
def _nominal(effective, n):
    if effective <= 0 or n < 1:
        raise Fail(NUM)
    if n == 2:
        return finite(2 * effective / (math.sqrt(1 + effective) + 1))
    return effective if n == 1 else _safe(lambda: n * math.expm1(math.log1p(effective) / n))


@scalar("PDURATION", "n n n")
def _pduration(rate, pv, fv):
    if rate <= 0 or pv <= 0 or fv <= 0:
        raise Fail(NUM)
    return _safe(lambda: (math.log1p((fv - pv) / pv) if 0.5 < fv / pv < 2 else math.log(fv / pv)) / math.log1p(rate))


@scalar("RRI", "n n n")
def _rri(n, pv, fv):
    if n <= 0 or pv == 0:
        raise Fail(NUM)
    ratio = (fv - pv) / pv
    if n == 1 or ratio == -1:
        return finite(ratio)
    if ratio < -1:
        raise Fail(NUM)
    return _safe(lambda: math.expm1(math.log1p(ratio) / n))


def _safe(f: Callable[[], float]) -> float:
    try:
        return finite(f())
    except (OverflowError, ValueError, ZeroDivisionError):
        raise Fail(NUM) from None


def newton(worth: Callable[[float], tuple[float, float]], guess: float, *, steps: int = STEPS, tolerance: float = TOLERANCE, polish: int = 0) -> float | None:
    """A root from guess: Newton steps, secant ones where Newton has no good step; None without convergence."""
    r, held = guess, None
    for _ in range(steps):
        f, slope = worth(r)
        if not math.isfinite(f):
            return None
        if f == 0:
            return r
        new = r - f / slope if abs(slope) > 1e-14 and math.isfinite(slope) else None
        if new is None or new <= -1 or not math.isfinite(new):
            if held is None:
                other = r + 1.1e-7
                held = (other, worth(other)[0])
            bent = f - held[1]
            new = r - f * (r - held[0]) / bent if bent else None
            if new is None or new <= -1 or not math.isfinite(new):
                return None
        held = (r, f)
        if abs(new - r) <= tolerance:
            r = new
            for _ in range(polish):
                f, slope = worth(r)
                step = f / slope if abs(slope) > 1e-14 and math.isfinite(f) and math.isfinite(slope) else 0.0
                if step == 0 or not r - step > -1:
                    break
                r -= step
            return r
        r = new
    return None


@scalar("RATE", "n n n n=0 n=0 n=0.1")
def _rate(n, pmt, pv, fv, kind, guess):
    if n == 0 or guess <= -1:
        raise Fail(NUM)
    first = 1.0 if kind != 0 else 0.0
    if n == 1:
        below = pv + pmt * first
        if below == 0 or (pv + pmt + fv) / below >= 1:
            raise Fail(NUM)
        return finite(-(pv + pmt + fv) / below)
    if pmt == 0 and pv != 0 and n > 0:
        ratio = -fv / pv
        if ratio <= 0:
            raise Fail(NUM)
        return _safe(lambda: math.expm1(math.log(ratio) / n))

    def worth(r: float) -> tuple[float, float]:
        try:
            if r == 0:
                return pv + pmt * n + fv, n * (pv + pmt * ((n - 1) / 2 + first))
            # worth pv g + pmt (1/r + first) (g - 1) + fv, and its derivative
            g, less = growth(r, n)
            rise, inverse = n * g / (1 + r), 1 / r
            return pv * g + pmt * (inverse + first) * less + fv, pv * rise + pmt * (-inverse * inverse) * less + pmt * (inverse + first) * rise
        except Fail:
            return math.inf, math.nan

    found = newton(worth, guess, polish=4)
    if found is None:
        raise Fail(NUM)
    return 0.0 if abs(found) < 1e-14 else finite(found)


def flows(ev: Evaluator, nodes: list[Node]) -> list[float]:
    """Numbers among the cells of arrays and references; scalars given directly are coerced."""
    out: list[float] = []
    for node in nodes:
        x = ev.value(node)
        if isinstance(x, list) or ev.is_reference(node):
            out += [c for c in map(V.checked, V.flat(x)) if isinstance(c, float)]
        elif V.checked(x) is not None:
            out.append(V.num(x))
    return out


@form("NPV")
def _npv(ev: Evaluator, nodes: list[Node]) -> object:
    if len(nodes) < 2:
        raise Fail(VALUE)
    rate = V.num(ev.scalar(nodes[0]))
    given = flows(ev, nodes[1:])
    if rate == -1 and given:
        raise Fail(DIV0)
    total, factor = 0.0, 1.0
    for v in given:
        factor *= 1 + rate
        total += v / factor
    return finite(total)


def _mixed(values: list[float]) -> bool:
    return any(v > 0 for v in values) and any(v < 0 for v in values)


@form("IRR")
def _irr(ev: Evaluator, nodes: list[Node]) -> object:
    if not 1 <= len(nodes) <= 2:
        raise Fail(VALUE)
    given = flows(ev, nodes[:1])
    guess = 0.1 if len(nodes) < 2 or nodes[1].kind == "missing" else V.num(ev.scalar(nodes[1]))
    if not _mixed(given) or guess <= -1:
        raise Fail(NUM)

    def worth(r: float) -> tuple[float, float]:
        x, f, slope = 1 / (1 + r), 0.0, 0.0
        for v in reversed(given):
            slope = slope * x + f
            f = f * x + v
        return f, slope * (-x / (1 + r))

    found = newton(worth, guess)
    if found is None:
        raise Fail(NUM)
    return 0.0 if abs(found) < 1e-14 else finite(found)


@form("MIRR")
def _mirr(ev: Evaluator, nodes: list[Node]) -> object:
    if len(nodes) != 3:
        raise Fail(VALUE)
    given = flows(ev, nodes[:1])
    f, r = (V.num(ev.scalar(n)) for n in nodes[1:])
    n = len(given)
    if n < 2 or not _mixed(given):
        raise Fail(DIV0)
    if f == -1 or r == -1:
        raise Fail(DIV0)
    up = sum(v / (1 + r) ** (k + 1) for k, v in enumerate(given) if v > 0)
    down = sum(v / (1 + f) ** (k + 1) for k, v in enumerate(given) if v < 0)
    if down == 0:
        raise Fail(DIV0)
    base = -up * (1 + r) ** n / (down * (1 + f))
    return _safe(lambda: math.pow(base, 1 / (n - 1)) - 1)


def _dated(ev: Evaluator, values: Node, dates: Node) -> list[tuple[float, int]]:
    v = [V.num(x) if not isinstance(x, str) or x == "" else _bad(x) for x in map(V.checked, V.flat(ev.value(values)))]
    d = []
    for x in map(V.checked, V.flat(ev.value(dates))):
        try:
            d.append(whole_serial(ev, V.num(x)))
        except Fail as fail:
            raise Fail(NUM if fail.code == NUM else VALUE) from None
    if len(v) != len(d) or not v:
        raise Fail(NUM)
    if any(x < d[0] for x in d):
        raise Fail(NUM)
    return [(a, b - d[0]) for a, b in zip(v, d, strict=True)]


def _bad(x: object) -> float:
    raise Fail(VALUE)


@form("XNPV")
def _xnpv(ev: Evaluator, nodes: list[Node]) -> object:
    if len(nodes) != 3:
        raise Fail(VALUE)
    rate = V.num(ev.scalar(nodes[0]))
    given = _dated(ev, nodes[1], nodes[2])
    if rate <= -1:
        raise Fail(NUM)
    return finite(sum(v * math.exp(-math.log1p(rate) * d / 365) for v, d in given))


@form("XIRR")
def _xirr(ev: Evaluator, nodes: list[Node]) -> object:
    if not 2 <= len(nodes) <= 3:
        raise Fail(VALUE)
    by_day: dict[int, float] = {}
    for v, d in _dated(ev, nodes[0], nodes[1]):
        by_day[d] = by_day.get(d, 0.0) + v
    guess = 0.1 if len(nodes) < 3 or nodes[2].kind == "missing" else V.num(ev.scalar(nodes[2]))
    given = [(v, d) for d, v in sorted(by_day.items()) if v]
    if not given:
        return 0.0
    if guess <= -1 or not _mixed([v for v, _ in given]):
        raise Fail(NUM)

    def worth(r: float) -> tuple[float, float]:
        try:
            log = math.log1p(r)
            terms = [(v * math.exp(-log * d / 365), d / 365) for v, d in given]
        except (OverflowError, ValueError):
            return math.inf, math.nan
        return sum(t for t, _ in terms), -sum(t * d for t, d in terms) / (1 + r)

    found = newton(worth, guess, steps=LONG_STEPS, tolerance=1e-12)
    if found is None or abs(worth(found)[0]) > 1e-6 * sum(abs(v) for v, _ in given):
        found = _bracketed(lambda r: worth(r)[0], guess)
    return finite(found)


def _bracketed(worth: Callable[[float], float], guess: float) -> float:
    """A root between the first two neighbours of the probes and the guess that differ in sign."""
    seen = [(r, f) for r in sorted({*PROBES, guess}) if math.isfinite(f := worth(r))]
    for (low, a), (high, b) in zip(seen, seen[1:], strict=False):
        if a == 0:
            return low
        if a * b < 0 or b == 0:
            for _ in range(LONG_STEPS):
                middle = (low + high) / 2
                f = worth(middle)
                if f == 0 or high - low <= 1e-13:
                    return middle
                low, high = (middle, high) if (f > 0) == (a > 0) else (low, middle)
            return (low + high) / 2
    raise Fail(NUM)


