"""Financial functions: annuities in closed form, and cash-flow rates by iteration inside the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.values import DIV0, FUNCTIONS, NUM, VALUE, Val, bind, down, error, first_error, function, guarded, num

#: Iterations and tolerance of the rate solvers.
STEPS, TOLERANCE = 20, 1e-7
#: Rates between which XIRR looks for a change of sign, and steps of its bisection.
PROBES = (-0.999999, -0.99, -0.5, -0.1, 0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 10.0, 100.0, 1e3, 1e6, 1e12)
HALVINGS = 100


def _growth(rate: Column, n: Column) -> tuple[Column, Column, Column]:
    """(1 + rate)^n, that less 1, and whether it is out of range; small rates lose no digits."""
    log = n * F.log1p(F.when(rate > -1, rate))
    exact = (n == down(n)) & (F.abs(rate) >= 1e-5)
    power = F.pow(1 + rate, n)
    less = F.when(exact, power - 1).otherwise(F.expm1(log))
    whole = n == down(n)
    return F.when(exact, power).otherwise(1 + less), less, (F.abs(log) > 700) | ((rate <= -1) & ~whole) | ((rate == -1) & (n <= 0))


def _due(rate: Column, kind: Column) -> Column:
    return 1 + rate * F.when(kind != 0, 1.0).otherwise(0.0)


def _pmt(rate, n, pv, fv, kind) -> Column:
    g, less, _ = _growth(rate, n)
    return F.when(rate == 0, -F.try_divide(pv + fv, n)).otherwise(-F.try_divide((pv * g + fv) * rate, _due(rate, kind) * less))


def _fv(rate, n, pmt, pv, kind) -> Column:
    g, less, _ = _growth(rate, n)
    return F.when(rate == 0, -(pv + pmt * n)).otherwise(-pv * g - pmt * _due(rate, kind) * F.try_divide(less, rate))


@function("PMT", "n n n n=0 n=0", "number", finite=True, once=True)
def pmt(rate, n, pv, fv, kind):
    found = _pmt(rate, n, pv, fv, kind)
    return found, [((rate == 0) & (n == 0), DIV0), (_growth(rate, n)[2], NUM), (None, NUM)]


@function("FV", "n n n n=0 n=0", "number", finite=True, once=True)
def fv(rate, n, pmt_, pv, kind):
    return _fv(rate, n, pmt_, pv, kind), [((rate != 0) & _growth(rate, n)[2], NUM)]


@function("PV", "n n n n=0 n=0", "number", finite=True, once=True)
def pv(rate, n, pmt_, fv_, kind):
    g, less, bad = _growth(rate, n)
    found = F.when(rate == 0, -(fv_ + pmt_ * n)).otherwise(-F.try_divide(fv_ + pmt_ * _due(rate, kind) * F.try_divide(less, rate), g))
    return found, [((rate == -1) | bad, NUM)]


@function("NPER", "n n n n=0 n=0", "number", finite=True, once=True)
def nper(rate, pmt_, pv_, fv_, kind):
    ratio = F.try_divide(-rate * (pv_ + fv_), pmt_ * _due(rate, kind) + pv_ * rate)
    found = F.when(rate == 0, -F.try_divide(pv_ + fv_, pmt_)).otherwise(F.try_divide(F.log1p(F.when(ratio > -1, ratio)), F.log1p(F.when(rate > -1, rate))))
    return found, [((rate == 0) & (pmt_ == 0), DIV0), (None, NUM)]


def _ipmt(rate, per, n, pv_, fv_, kind) -> Column:
    pay = _pmt(rate, n, pv_, fv_, kind)
    owed = _fv(rate, per - 1, pay, pv_, kind) * rate
    return F.when((kind != 0) & (per == 1), 0.0).when(per == 1, -pv_ * rate).when(kind != 0, F.try_divide(owed, 1 + rate)).otherwise(owed)


@function("IPMT", "n n n n n=0 n=0", "number", finite=True, once=True)
def ipmt(rate, per, n, pv_, fv_, kind):
    return _ipmt(rate, per, n, pv_, fv_, kind), [((per < 1) | (per >= n + 1) | (_growth(rate, n)[2] & (rate != 0) & ~((kind != 0) & (per == 1))), NUM), (None, NUM)]


@function("PPMT", "n n n n n=0 n=0", "number", finite=True, once=True)
def ppmt(rate, per, n, pv_, fv_, kind):
    found = _pmt(rate, n, pv_, fv_, kind) - _ipmt(rate, per, n, pv_, fv_, kind)
    return found, [((per < 1) | (per >= n + 1), NUM), (None, NUM)]


def _interest(rate, n, pv_, start, end, kind) -> Column:
    """Interest paid in the periods start to end, as a geometric sum."""
    pay = _pmt(rate, n, pv_, F.lit(0.0), kind)
    first = F.when(kind == 0, start).otherwise(F.greatest(start, F.lit(2.0)))
    count = F.greatest(end - first + 1, F.lit(0.0))
    before = F.when(kind == 0, first - 1).otherwise(first - 2)
    total = _growth(rate, before)[0] * _growth(rate, count)[1] / rate
    grown = F.when(kind == 0, total).otherwise(total * (1 + rate))
    # an even payment less what is repaid, period by period
    return F.when(count == 0, 0.0).when((kind == 0) & (end == 1), -pv_ * rate).otherwise(pay * (count - grown) - total * pv_ * rate)


def _cumulative_bad(rate, n, pv_, start, end, kind) -> Column:
    return (rate <= 0) | (n <= 0) | (pv_ <= 0) | (start < 1) | (end < start) | (end > n) | ((kind != 0) & (kind != 1))


@function("CUMIPMT", "n i n i i i", "number", finite=True, once=True)
def cumipmt(rate, n, pv_, start, end, kind):
    bad = _cumulative_bad(rate, n, pv_, start, end, kind)
    return F.when(~bad, _interest(rate, n, pv_, start, end, kind)), [(bad, NUM)]


@function("CUMPRINC", "n n n i i i", "number", finite=True, once=True)
def cumprinc(rate, n, pv_, start, end, kind):
    bad = _cumulative_bad(rate, n, pv_, start, end, kind)
    pay = _pmt(rate, n, pv_, F.lit(0.0), kind)
    fallen = _fv(rate, start - 1, pay, pv_, F.lit(0.0)) - _fv(rate, end, pay, pv_, F.lit(0.0))
    return F.when(~bad, F.when(kind == 0, fallen).otherwise(pay * (end - start + 1) - _interest(rate, n, pv_, start, end, kind))), [(bad, NUM)]


@function("EFFECT", "n i", "number", finite=True, once=True)
def effect(nominal_, n):
    return F.when(n == 1, nominal_).otherwise(_growth(F.when(n >= 1, nominal_ / n), n)[1]), [((nominal_ <= 0) | (n < 1), NUM)]


@function("NOMINAL", "n i", "number", finite=True, once=True)
def nominal(effective, n):
    return F.when(n == 1, effective).when(n == 2, 2 * effective / (F.sqrt(F.when(effective > -1, 1 + effective)) + 1)).otherwise(n * F.expm1(F.try_divide(F.log1p(F.when(effective > -1, effective)), n))), [((effective <= 0) | (n < 1), NUM)]


@function("PDURATION", "n n n", "number", finite=True, once=True)
def pduration(rate, pv_, fv_):
    bad = (rate <= 0) | (pv_ <= 0) | (fv_ <= 0)
    ratio = fv_ / pv_
    log = F.when((ratio > 0.5) & (ratio < 2), F.log1p((fv_ - pv_) / pv_)).otherwise(F.ln(ratio))
    return F.when(~bad, log / F.log1p(rate)), [(bad, NUM)]


@function("RRI", "n n n", "number", finite=True, once=True)
def rri(n, pv_, fv_):
    ratio = F.try_divide(fv_ - pv_, pv_)
    found = F.when(n == 1, ratio).otherwise(F.expm1(F.try_divide(F.log1p(F.when(ratio > -1, ratio).when(ratio == -1, None)), n)))
    found = F.when((ratio == -1) & (n > 0), -1.0).otherwise(found)
    return found, [((n <= 0) | (pv_ == 0), NUM), (None, NUM)]


def _balance(r: Column, n, pay, pv_, fv_, kind) -> Column:
    g = F.pow(1 + r, n)
    annuity = F.when(F.abs(r) < 1e-12, n).otherwise(F.try_divide(g - 1, r))
    return pv_ * g + pay * _due(r, kind) * annuity + fv_


def _solve(value, guess: Column) -> Column:
    """A root of value(r) by secant steps, 3 * STEPS at most; null if none is met.

    Each step evaluates value once, and none once the root is found.
    """
    start = F.struct(guess.alias("a"), (guess * 1.01 + 1e-4).alias("b"), value(guess).alias("fa"), F.lit(False).alias("done"))

    def move(s: Column, fb: Column) -> Column:
        def settle(new: Column) -> Column:
            stuck = new.isNull() | F.isnan(new)
            near = F.coalesce((F.abs(new - s["b"]) <= 1e-13) | (fb == 0), F.lit(False))
            # equal worths end no search: the last two points stay apart
            return F.struct(F.when(stuck, s["a"]).otherwise(s["b"]).alias("a"), F.when(stuck, s["b"]).otherwise(new).alias("b"), F.when(stuck, s["fa"]).otherwise(fb).alias("fa"), (stuck & (fb == 0) | near).alias("done"))

        new = s["b"] - F.try_divide(fb * (s["b"] - s["a"]), fb - s["fa"])
        return bind([F.when(new <= -1, (s["b"] - 1) / 2).otherwise(new)], settle)

    step = lambda s, _: F.when(s["done"], s).otherwise(bind([value(s["b"])], lambda fb: move(s, fb)))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(3 * STEPS)), start, step)
    return bind([end], lambda s: F.when(s["done"] | (F.abs(s["b"] - s["a"]) <= TOLERANCE), s["b"]))


def _bisect(value, guess: Column) -> Column:
    """A root of value(r) between the first two neighbours of PROBES and the guess that differ in sign; null without such."""
    probes = F.array_sort(F.array_distinct(F.array(*[F.lit(p) for p in PROBES], guess)))
    worth = F.transform(probes, lambda r: F.struct(r.alias("r"), value(r).alias("f")))
    finite = F.filter(worth, lambda p: (p["r"] > -1) & (F.abs(p["f"]) < float("inf")))

    def brackets(seen: Column) -> Column:
        pairs = F.zip_with(F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))), F.slice(seen, 2, F.size(seen)), lambda x, y: F.struct(x["r"].alias("lo"), y["r"].alias("hi"), F.signum(x["f"]).alias("sign"), F.signum(y["f"]).alias("next")))
        return F.get(F.filter(pairs, lambda p: p["sign"] * p["next"] <= 0), F.lit(0))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2

        def side(sign: Column) -> Column:
            low = s["sign"] * sign > 0
            return F.struct(F.when(low, middle).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(middle).alias("hi"), s["sign"].alias("sign"))

        return F.when(s["hi"] - s["lo"] <= 1e-13, s).otherwise(bind([F.signum(value(middle))], side))

    start = bind([finite], lambda seen: bind([brackets(seen)], lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["sign"].alias("sign"))))
    return bind([F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)], lambda s: (s["lo"] + s["hi"]) / 2)


@function("RATE", "n n n n=0 n=0 n=0.1", "number", finite=True, once=True)
def rate(n, pay, pv_, fv_, kind, guess):
    found = _solve(lambda r: _balance(r, n, pay, pv_, fv_, kind), guess)
    found = bind([found], lambda r: F.when(F.abs(r) < 1e-14, 0.0).otherwise(r))
    return found, [((n <= 0) | (guess <= -1), NUM), (None, NUM)]


def npv_of(rate_: Column, flows: Column) -> Column:
    """Present value of an array of flows, the first one period away; null flows take no period."""
    kept = F.array_compact(flows)
    return F.aggregate(F.reverse(kept), F.lit(0.0), lambda a, v: (a + v) / (1 + rate_))


def npv(rate_: object, *flows: object) -> Val:
    r = num(rate_)
    if len(flows) == 1 and isinstance(flows[0], Column):
        return guarded("number", F.when(r.v != -1, npv_of(r.v, flows[0])), first_error(r.e, F.when(r.v == -1, F.lit(DIV0))))
    if not flows:
        return error(VALUE)
    vals = [num(f) for f in flows]
    return guarded("number", F.when(r.v != -1, npv_of(r.v, F.array(*[v.v for v in vals]))), first_error(r.e, *[v.e for v in vals], F.when(r.v == -1, F.lit(DIV0))))


def _flow_array(flows: object) -> tuple[Column, Column | None]:
    """An array of flows as it is; one value as an array, with its error."""
    if isinstance(flows, Column):
        return flows, None
    one = num(flows)
    return F.array(one.v), one.e


def irr(flows: object, guess: object = 0.1) -> Val:
    """Rate at which an array of flows is worth nothing; it needs both signs."""
    flows, err = _flow_array(flows)
    kept = F.array_compact(flows)
    mixed = F.exists(kept, lambda v: v > 0) & F.exists(kept, lambda v: v < 0)
    worth = lambda r: F.aggregate(F.reverse(kept), F.lit(0.0), lambda a, v: a / (1 + r) + v)
    g = num(guess)
    found = F.when(mixed, _solve(worth, g.v))
    return guarded("number", found, first_error(err, g.e, F.when(found.isNull(), F.lit(NUM))))


def mirr(flows: object, finance: object, reinvest: object) -> Val:
    flows, err = _flow_array(flows)
    err = first_error(err, num(finance).e, num(reinvest).e)
    f, r = num(finance).v, num(reinvest).v
    kept = F.array_compact(flows)
    n = F.size(kept)
    gains, losses = F.transform(kept, lambda v: F.when(v > 0, v).otherwise(0.0)), F.transform(kept, lambda v: F.when(v < 0, v).otherwise(0.0))
    up, down = npv_of(r, gains), npv_of(f, losses)
    bad = (n < 2) | ~F.exists(kept, lambda v: v > 0) | ~F.exists(kept, lambda v: v < 0)
    found = F.pow(F.try_divide(-up * F.pow(1 + r, n), down * (1 + f)), F.try_divide(F.lit(1.0), n - 1)) - 1
    return guarded("number", found, first_error(err, F.when(bad, F.lit(DIV0))))


def _dated(r: Column, flows: Column) -> Column:
    """Worth at the first date of (value, date) pairs, in years of 365 days."""
    return F.element_at(
        F.transform(F.array(flows), lambda x: F.aggregate(x, F.lit(0.0), lambda a, p: a + p["value"] * F.exp(-F.log1p(r) * (p["date"] - F.get(x, F.lit(0))["date"]) / 365))), 1
    )


def xnpv(rate_: object, flows: Column) -> Val:
    """flows: array of (value, date); the first date is the start, none may come before it."""
    r = num(rate_).v
    early = F.exists(flows, lambda p: p["date"] < F.get(flows, F.lit(0))["date"])
    return guarded("number", F.when(r > -1, _dated(r, flows)), first_error(F.when((r <= -1) | early, F.lit(NUM)), F.when(F.size(flows) == 0, F.lit(VALUE))))


def xirr(flows: Column, guess: object = 0.1) -> Val:
    """Rate at which dated flows are worth nothing, of those between the ends of PROBES."""
    mixed = F.exists(flows, lambda p: p["value"] > 0) & F.exists(flows, lambda p: p["value"] < 0)
    worth, first = lambda r: _dated(r, flows), num(guess).v
    found = F.when(mixed, F.coalesce(_solve(worth, first), F.when(first > -1, _bisect(worth, first))))
    found = bind([found], lambda r: F.when((r >= PROBES[0]) & (r <= PROBES[-1]), r))
    return guarded("number", found, F.when(found.isNull(), F.lit(NUM)))


FUNCTIONS |= {"NPV": npv, "IRR": irr, "MIRR": mirr, "XNPV": xnpv, "XIRR": xirr}
