"""Dates as serial numbers (1900 system: 1 is 1900-01-01, 60 the day that never was)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.values import FUNCTIONS, NUM, VALUE, Val, bind, down, error, first_error, function, guarded, num, trunc0

LAST = 2958465
#: The 1904 system starts this many days later.
OFFSET_1904 = 1462
_ORIGIN = "1899-12-30"


def _pmod(a: Column, n: int) -> Column:
    return a - n * down(a / n)


def first_of_month(y: Column, m: Column) -> Column:
    """Serial of the first day of a month; m may be out of 1 to 12."""

    def days(month: Column) -> Column:
        year = down(month / 12)
        date = F.make_date(F.least(F.greatest(year, F.lit(1899)), F.lit(9999)).cast("int"), (_pmod(month, 12) + 1).cast("int"), F.lit(1))
        # beyond the years that dates have, a year more or less is out of range all the same
        past = F.greatest(year - 9999, F.lit(0)) + F.least(year - 1899, F.lit(0))
        return (F.datediff(date, F.lit(_ORIGIN).cast("date")) + past * 366).cast("double")

    return bind([bind([y * 12 + m - 1], days)], lambda d: F.when(d < 61, d - 1).otherwise(d))


def civil(s: Column) -> Column:
    """Struct of year, month and day of a whole serial; 0 is 1900-01-00 and 60 is 1900-02-29."""

    def parts(s: Column) -> Column:
        inside = F.when((s >= 0) & (s <= LAST), F.when(s >= 61, s).otherwise(s + 1)).cast("int")
        date = F.date_add(F.lit(_ORIGIN).cast("date"), inside)
        pick = lambda usual, at0, at60: F.when(s == 60, at60).when(s == 0, at0).otherwise(usual).cast("double")
        return F.struct(pick(F.year(date), 1900, 1900).alias("y"), pick(F.month(date), 1, 2).alias("m"), pick(F.dayofmonth(date), 0, 29).alias("d"))

    return bind([down(s)], parts)


def with_civil(serials: list[Column], body) -> Column:
    """body(y, m, d, ...) of each serial in turn."""
    return bind([civil(s) for s in serials], lambda *t: body(*[x[k] for x in t for k in ("y", "m", "d")]))


def _outside(s: Column) -> tuple[Column, str]:
    return (s < 0) | (s >= LAST + 1), NUM


def _inside(s: Column) -> Column:
    return bind([s], lambda x: F.when((x >= 0) & (x <= LAST), x))


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0) | (y == 1900)


def _days_in_month(y: Column, m: Column) -> Column:
    return first_of_month(y, m + 1) - first_of_month(y, m)


@function("DATE", "i i i", "number", once=True)
def date(y, m, d):
    year = F.when((y >= 0) & (y < 1900), y + 1900).otherwise(y)
    s = bind([first_of_month(year, m) + d - 1], lambda s: F.when((s >= 0) & (s <= LAST), s))
    return s, [((y < 0) | (y > 9999), NUM), (None, NUM)]


@function("TIME", "i i i", "number", once=True)
def time(h, m, s):
    total = h * 3600 + m * 60 + s
    return _pmod(total, 86400) / 86400, [((total < 0) | (h > 32767) | (m > 32767) | (s > 32767), NUM)]


def _civil_date(s: Column) -> Column:
    """The date of a serial from 61 on; null elsewhere."""
    return F.date_add(F.lit(_ORIGIN).cast("date"), F.when(_usual(s), F.floor(s)).cast("int"))


def _usual(s: Column) -> Column:
    return (s >= 61) & (s < LAST + 1)


def _moved(s: Column, months: Column, last: bool, otherwise: Column) -> Column:
    """The serial so many months on (or the last of that month) by Spark's own date functions, where
    they agree with the 1900 system: from 1 March 1900 on."""
    date = F.add_months(_civil_date(s), F.when(F.abs(months) < 12 * 9000, months).cast("int"))
    days = F.datediff(F.last_day(date) if last else date, F.lit(_ORIGIN).cast("date")).cast("double")
    return bind([days], lambda d: F.when((d >= 61) & (d <= LAST), d).otherwise(otherwise))


@function("YEAR", "n", "number", once=True)
def year(s):
    return F.when(_usual(s), F.year(_civil_date(s)).cast("double")).otherwise(civil(s)["y"]), [_outside(s)]


@function("MONTH", "n", "number", once=True)
def month(s):
    return F.when(_usual(s), F.month(_civil_date(s)).cast("double")).otherwise(civil(s)["m"]), [_outside(s)]


@function("DAY", "n", "number", once=True)
def day(s):
    return F.when(_usual(s), F.dayofmonth(_civil_date(s)).cast("double")).otherwise(civil(s)["d"]), [_outside(s)]


@function("EDATE", "n i", "number", once=True)
def edate(s, months):
    """The same day so many months on, at most the month's last; none before 1900."""
    found = with_civil([s], lambda y, m, d: F.when(y * 12 + m + months > 1900 * 12, _inside(first_of_month(y, m + months) + F.least(d, _days_in_month(y, m + months)) - 1)))
    return _moved(s, months, False, found), [_outside(s), (None, NUM)]


@function("EOMONTH", "n i", "number", once=True)
def eomonth(s, months):
    found = with_civil([s], lambda y, m, d: F.when(y * 12 + m + months > 1900 * 12, _inside(first_of_month(y, m + months + 1) - 1)))
    return _moved(s, months, True, found), [_outside(s), (None, NUM)]


@function("WEEKDAY", "n i=1", "number", once=True)
def weekday(s, kind):
    d = down(s)
    start = F.when(kind == 1, 1).when(kind == 2, 2).when((kind >= 11) & (kind <= 17), kind - 9)
    found = F.when(kind == 3, _pmod(d - 2, 7)).otherwise(_pmod(d - start, 7) + 1)
    return found.cast("double"), [_outside(s), (None, NUM)]


def _iso_week(d: Column) -> Column:
    week = bind([F.greatest(d - _pmod(d - 2, 7) + 3, F.lit(0))], lambda t: down((t - first_of_month(civil(t)["y"], F.lit(1))) / 7) + 1)
    return F.when(d <= 1, 52.0).otherwise(week)


@function("WEEKNUM", "n i=1", "number", once=True)
def weeknum(s, kind):
    d = down(s)
    start = F.when((kind == 1) | (kind == 17), 1).when((kind == 2) | (kind == 11), 2).when((kind >= 12) & (kind <= 16), kind - 9)
    jan1 = first_of_month(civil(d)["y"], F.lit(1))
    found = bind([jan1], lambda j: down((d - j + _pmod(j - start, 7)) / 7) + 1)
    return F.when(kind == 21, _iso_week(d)).otherwise(found).cast("double"), [_outside(s), (start.isNull() & (kind != 21), NUM)]


@function("ISOWEEKNUM", "n", "number", once=True)
def isoweeknum(s):
    return _iso_week(down(s)).cast("double"), [_outside(s)]


def _mask(weekend: object, one_sided: bool) -> tuple[list[int] | None, str | None]:
    """Working days as serial mod 7 (0 is Saturday), and the error of a bad weekend."""
    if isinstance(weekend, str):
        if len(weekend) != 7 or set(weekend) - {"0", "1"} or (one_sided and weekend == "1111111"):
            return None, VALUE
        off = {(k + 2) % 7 for k, c in enumerate(weekend) if c == "1"}
    else:
        code = int(weekend)
        if 1 <= code <= 7:
            off = {(code + 6) % 7, code % 7}
        elif 11 <= code <= 17:
            off = {(code - 10) % 7}
        else:
            return None, NUM
    return [k for k in range(7) if k not in off], None


def _through(n: Column, work: list[int]) -> Column:
    """Working days among the serials 0 to n."""
    prefix = F.lit([sum(w < k for w in work) for k in range(7)])
    return len(work) * down((n + 1) / 7) + F.get(prefix, _pmod(n + 1, 7).cast("int"))


def _nth(w: Column, work: list[int]) -> Column:
    """The serial of the w-th working day from serial 0 on."""
    return 7 * down((w - 1) / len(work)) + F.get(F.lit(work), _pmod(w - 1, len(work)).cast("int"))


def _holidays(given: object, work: list[int]) -> tuple[Column | None, Column | None]:
    """Distinct whole serials on working days, and the error of a value that is no date.

    given is an array column, a list of values, or one value.
    """
    if given is None or (isinstance(given, list) and not given):
        return None, None
    err = None
    if isinstance(given, Column):
        column = given
    else:
        vals = [num(h) for h in (given if isinstance(given, list) else [given])]
        column = F.array(*[v.v for v in vals])
        err = first_error(*[v.e for v in vals], F.when(F.exists(column, lambda h: (h < 0) | (h >= LAST + 1)), F.lit(NUM)))
    return _on_working_days(column, work), err


def _on_working_days(column: Column, work: list[int]) -> Column:
    return F.array_distinct(F.filter(F.transform(column, lambda h: down(h)), lambda h: F.array_contains(F.lit(work), F.pmod(h, F.lit(7)).cast("int"))))


def networkdays_intl(start: object, end: object, weekend: object = 1, holidays: object = None) -> Val:
    a, b = num(start), num(end)
    work, bad = _mask(1 if weekend is None else weekend, False)
    if bad:
        return error(bad)
    off, wrong = _holidays(holidays, work)

    def count(x: Column, y: Column) -> Column:
        low, high = F.least(x, y), F.greatest(x, y)
        n = _through(high, work) - _through(low - 1, work)
        if off is not None:
            n = n - F.size(F.filter(off, lambda h: (h >= low) & (h <= high)))
        good = (low >= 0) & (high <= LAST)
        return F.when(good, n * F.when(x > y, -1).otherwise(1)).cast("double")

    found = bind([down(a.v), down(b.v)], count)
    return guarded("number", found, first_error(a.e, b.e, wrong, F.when(found.isNull(), F.lit(NUM))))


def networkdays(start: object, end: object, holidays: object = None) -> Val:
    return networkdays_intl(start, end, 1, holidays)


def workday_intl(start: object, days: object, weekend: object = 1, holidays: object = None) -> Val:
    a, n = num(start), num(days)
    work, bad = _mask(1 if weekend is None else weekend, True)
    if bad:
        return error(bad)
    off, wrong = _holidays(holidays, work)

    def move(s: Column, d: Column) -> Column:
        after = lambda k: _nth(_through(s, work) + k, work)
        before = lambda k: _nth(_through(s - 1, work) - k + 1, work)
        if off is None:
            forward, back = after(d), before(-d)
        else:
            # holidays on the way move the day on, which may pass further holidays
            rounds = F.sequence(F.lit(0), F.size(off))
            met = F.aggregate(rounds, F.lit(0), lambda m, _: F.size(F.filter(off, lambda h: (h > s) & (h <= after(d + m)))))
            missed = F.aggregate(rounds, F.lit(0), lambda m, _: F.size(F.filter(off, lambda h: (h < s) & (h >= before(-d + m)))))
            forward, back = after(d + met), before(-d + missed)
        found = F.when(d == 0, s).when(d > 0, forward).otherwise(back).cast("double")
        return F.when((s >= 0) & (s <= LAST), _inside(found))

    found = bind([down(a.v), trunc0(n.v)], move)
    return guarded("number", found, first_error(a.e, n.e, wrong, F.when(found.isNull(), F.lit(NUM))))


def workday(start: object, days: object, holidays: object = None) -> Val:
    return workday_intl(start, days, 1, holidays)


FUNCTIONS |= {"NETWORKDAYS": networkdays, "NETWORKDAYS.INTL": networkdays_intl, "WORKDAY": workday, "WORKDAY.INTL": workday_intl}


def _feb_end(y: Column, m: Column, d: Column) -> Column:
    return (m == 2) & (d == _days_in_month(y, F.lit(2)))


def _thirty(y1, m1, d1, y2, m2, d2) -> Column:
    return (y2 - y1) * 360 + (m2 - m1) * 30 + (d2 - d1)


@function("DAYS360", "n n b=FALSE", "number", once=True)
def days360(a, b, european):
    def count(y1, m1, d1, y2, m2, d2):
        eu = _thirty(y1, m1, F.least(d1, F.lit(30)), y2, m2, F.least(d2, F.lit(30)))
        start = F.when((d1 == 31) | _feb_end(y1, m1, d1), 30).otherwise(d1)
        us = bind([start], lambda s: _thirty(y1, m1, s, y2, m2, F.when((d2 == 31) & (s >= 30), 30).otherwise(d2)))
        return F.when(european, eu).otherwise(us).cast("double")

    return with_civil([a, b], count), [_outside(a), _outside(b)]


def _year_fraction(basis: Column, days: Column, a: Column, b: Column, y1, m1, d1, y2, m2, d2) -> Column:
    both, first, last = (d1 == 31) & (d2 == 31), d1 == 31, (d1 == 30) & (d2 == 31)
    feb1, feb2 = _feb_end(y1, m1, d1), _feb_end(y2, m2, d2)
    s = F.when(both | first, 30).when(last, d1).when(feb1, 30).otherwise(d1)
    e = F.when(both, 30).when(first, d2).when(last, 30).when(feb1 & feb2, 30).otherwise(d2)
    us = _thirty(y1, m1, s, y2, m2, e) / 360
    eu = _thirty(y1, m1, F.least(d1, F.lit(30)), y2, m2, F.least(d2, F.lit(30))) / 360
    short = (y1 == y2) | ((y2 == y1 + 1) & ((m1 > m2) | ((m1 == m2) & (d1 >= d2))))
    leap1 = _leap(y1) & (a <= first_of_month(y1, F.lit(3)) - 1)
    leap2 = _leap(y2) & (b >= first_of_month(y2, F.lit(3)) - 1)
    year_days = F.when(F.when(y1 == y2, _leap(y1)).otherwise(leap1 | leap2), 366).otherwise(365)
    span = first_of_month(y2 + 1, F.lit(1)) - first_of_month(y1, F.lit(1))
    actual = F.when(short, days / year_days).otherwise(days * (y2 - y1 + 1) / span)
    return F.when(basis == 0, us).when(basis == 1, actual).when(basis == 2, days / 360).when(basis == 3, days / 365).when(basis == 4, eu)


@function("YEARFRAC", "n n i=0", "number", once=True)
def yearfrac(start, end, basis):
    found = bind(
        [down(F.least(start, end)), down(F.greatest(start, end))],
        lambda a, b: with_civil([a, b], lambda *parts: _year_fraction(basis, b - a, a, b, *parts)),
    )
    return found, [_outside(start), _outside(end), ((basis < 0) | (basis > 4), NUM)]
