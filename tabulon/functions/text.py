"""Text functions."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.values import FUNCTIONS, NA, VALUE, Val, as_int, as_val, bind, down, error, first_error, function, guarded, num, r15, trunc0, txt
from tabulon.functions.values import _LOWER as _SMALL
from tabulon.functions.values import _UPPER as _CAPITAL

#: Longest text a cell holds, in UTF-16 units.
CELL_UNITS = 32767


def _units(t: Column) -> Column:
    return F.octet_length(F.encode(t, "UTF-16BE")) / 2


def _too_long(t: Column) -> tuple[Column, str]:
    return (F.length(t) > CELL_UNITS // 2) & (_units(t) > CELL_UNITS), VALUE


def _quote(t: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


@function("LEN", "s", "number")
def len_(t):
    return F.length(t).cast("double")


@function("LEFT", "s i=1", "text")
def left(t, n):
    return F.substring(t, F.lit(1), as_int(n)), [(n < 0, VALUE)]


@function("RIGHT", "s i=1", "text")
def right(t, n):
    return F.when(n <= 0, "").otherwise(F.right(t, as_int(n))), [(n < 0, VALUE)]


@function("MID", "s i i", "text")
def mid(t, start, n):
    return F.substring(t, as_int(start), as_int(n)), [((start < 1) | (n < 0), VALUE)]


@function("LOWER", "s", "text")
def lower(t):
    return F.lower(t)


@function("UPPER", "s", "text")
def upper(t):
    """Sharp s has no capital."""
    return F.when(t.contains("ß"), F.array_join(F.transform(F.split(t, "ß", -1), F.upper), "ß")).otherwise(F.upper(t))


@function("PROPER", "s", "text")
def proper(t):
    """Capitals after anything but A-Z letters; only A-Z letters change."""
    chars = F.split(t, "")

    def cased(all_: Column) -> Column:
        inner = lambda i: (i > 0) & F.coalesce(F.get(all_, i - 1).rlike("[A-Za-z]"), F.lit(False))
        return F.transform(all_, lambda c, i: F.when(inner(i), F.translate(c, _CAPITAL, _SMALL)).otherwise(F.translate(c, _SMALL, _CAPITAL)))

    return F.array_join(F.element_at(F.transform(F.array(chars), cased), 1), "")


@function("TRIM", "s", "text")
def trim(t):
    return F.trim(F.regexp_replace(t, " +", " "))


@function("CLEAN", "s", "text")
def clean(t):
    return F.regexp_replace(t, r"[\x00-\x1F]", "")


@function("EXACT", "s s", "bool")
def exact(a, b):
    return a == b


def find(needle: object, hay: object, start: object = 1.0) -> Val:
    """Case-sensitive place; an empty needle is at the start."""
    a, b, s = txt(needle), txt(hay), num(start)
    at, size = trunc0(s.v), F.length(b.v)
    place = F.when(a.v == "", at).otherwise(F.call_function("locate", a.v, b.v, as_int(at)).cast("double"))
    bad = (at < 1) | (at > size + 1)
    err = first_error(a.e, b.e, s.e, F.when(bad | (place == 0), F.lit(VALUE)))
    return guarded("number", place, err)


FUNCTIONS["FIND"] = find


def wildcard_regex(pattern: str) -> str:
    """A regular expression for * (any run), ? (one character) and ~ (the next one as it is)."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "~" and k + 1 < len(pattern) and pattern[k + 1] in "*?~":
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        k += 1
    return "".join(out)


def search(pattern: object, hay: object, start: object = 1.0) -> Val:
    """Place of the first match without case; the pattern is a literal with wildcards."""
    if not isinstance(pattern, str):
        p = txt(pattern)
        escaped = F.regexp_replace(p.v, r"([\\.\[\]{}()+\-^$|])", r"\\$1")
        held = F.replace(F.replace(F.replace(escaped, F.lit("~~"), F.lit("\x01")), F.lit("~*"), F.lit("\x02")), F.lit("~?"), F.lit("\x03"))
        wild = F.replace(F.replace(held, F.lit("*"), F.lit(".*?")), F.lit("?"), F.lit("."))
        wild = F.replace(F.replace(wild, F.lit(".*."), F.lit(".*?")), F.lit("\x01"), F.lit("~"))
        regex = F.concat(F.lit("(?is)"), F.replace(F.replace(wild, F.lit("\x02"), F.lit("\\*")), F.lit("\x03"), F.lit("\\?")))
        empty, err = p.v == "", p.e
    else:
        regex, empty, err = F.lit("(?is)" + wildcard_regex(pattern).replace(".*", ".*?")), F.lit(pattern == ""), None
    b, s = txt(hay), num(start)
    at = trunc0(s.v)
    rest = F.substring(b.v, as_int(at), F.length(b.v))
    place = F.when(empty, at).otherwise(F.regexp_instr(rest, regex) + at - 1)
    miss = (at < 1) | (at > F.length(b.v)) | (~empty & (F.regexp_instr(rest, regex) == 0))
    err = first_error(err, b.e, s.e, F.when(miss, F.lit(VALUE)))
    return guarded("number", place.cast("double"), err)


FUNCTIONS["SEARCH"] = search


def substitute(t: object, old: object, new: object, instance: object = None) -> Val:
    a, o, n = txt(t), txt(old), txt(new)
    if instance is None:
        return guarded("text", F.when(o.v == "", a.v).otherwise(F.replace(a.v, o.v, n.v)), first_error(a.e, o.e, n.e))
    i = num(instance)
    k = as_int(trunc0(i.v))
    parts = F.split(a.v, _quote(o.v), -1)
    join = lambda some: F.call_function("array_join", some, o.v)
    glued = F.concat(join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(1)))), n.v, join(F.slice(parts, F.greatest(k, F.lit(1)) + 1, F.size(parts))))
    value = F.when((o.v == "") | (F.size(parts) <= k), a.v).otherwise(glued)
    return guarded("text", value, first_error(a.e, o.e, n.e, i.e, F.when(k < 1, F.lit(VALUE))))


FUNCTIONS["SUBSTITUTE"] = substitute


@function("REPLACE", "s i i s", "text")
def replace(t, start, n, new):
    at = as_int(start)
    return F.concat(F.substring(t, F.lit(1), at - 1), new, F.substring(t, at + as_int(n), F.length(t))), [((start < 1) | (n < 0), VALUE)]


@function("REPT", "s i", "text")
def rept(t, n):
    count = F.greatest(F.least(n, F.lit(float(CELL_UNITS + 1))), F.lit(0.0)).cast("int")
    over = (_units(t) * count) > CELL_UNITS
    return F.when(~over, F.repeat(t, count)), [((n < 0) | over, VALUE)]


#: Windows-1252 characters 0x80 to 0x9F; None where the code is not assigned.
WINDOWS_1252 = [
    "€", None, "‚", "ƒ", "„", "…", "†", "‡", "ˆ", "‰", "Š", "‹", "Œ", None, "Ž", None,
    None, "‘", "’", "“", "”", "•", "–", "—", "˜", "™", "š", "›", "œ", None, "ž", "Ÿ",
]


#: The 255 characters in a row; their places are their codes.
_CHARACTERS = "".join(chr(k) for k in range(1, 128)) + "".join(c or chr(128 + k) for k, c in enumerate(WINDOWS_1252)) + "".join(chr(k) for k in range(160, 256))


@function("CHAR", "i", "text")
def char(n):
    return F.substring(F.lit(_CHARACTERS), as_int(n), F.lit(1)), [((n < 1) | (n > 255), VALUE)]


@function("CODE", "s", "number")
def code(t):
    first = F.substring(t, 1, 1)
    point = F.ascii(first)
    special = F.array_position(F.lit([c or "" for c in WINDOWS_1252]), first)
    value = F.when((point < 128) | ((point >= 160) & (point < 256)), point).when(special > 0, special + 127)
    direct = (point >= 128) & (point < 160)
    return F.when(direct, point).otherwise(value).cast("double"), [((t == "") | F.coalesce(~direct & value.isNull(), F.lit(True)), VALUE)]


@function("UNICODE", "s", "number")
def unicode(t):
    return F.ascii(t).cast("double"), [(t == "", VALUE)]


@function("UNICHAR", "i", "text")
def unichar(n):
    surrogate = (n >= 0xD800) & (n <= 0xDFFF)
    good = (n >= 1) & (n <= 0x10FFFF) & ~surrogate
    shown = F.decode(F.unhex(F.lpad(F.hex(F.when(good, n).cast("bigint")), 8, "0")), "UTF-32")
    return F.when(good, shown), [(surrogate, NA), (~good, VALUE)]


def concat(*parts: object) -> Val:
    """All texts in a row; over 32,767 units #VALUE!."""
    vals = [txt(p) for p in parts]
    joined = F.concat(*[v.v for v in vals])
    limit, what = _too_long(joined)
    return guarded("text", joined, first_error(*[v.e for v in vals], F.when(limit, F.lit(what))))


def textjoin(delimiter: object, ignore_empty: object, *parts: object) -> Val:
    d, vals = txt(delimiter), [txt(p) for p in parts]
    every = F.array(*[v.v for v in vals])
    kept = F.filter(every, lambda x: x != "") if ignore_empty else every
    body = F.aggregate(
        F.slice(kept, F.lit(2), F.greatest(F.size(kept), F.lit(1))), F.coalesce(F.get(kept, F.lit(0)), F.lit("")), lambda a, x: F.concat(a, d.v, x)
    )
    limit, what = _too_long(body)
    return guarded("text", body, first_error(d.e, *[v.e for v in vals], F.when(limit, F.lit(what))))


FUNCTIONS |= {"CONCAT": concat, "TEXTJOIN": textjoin}


def _hits(t: Column, delimiters: list[str], any_case: bool) -> tuple[Column, Column]:
    """Texts between delimiters and the delimiters met."""
    regex = ("(?iu)" if any_case else "") + "(" + "|".join(re.escape(d) for d in delimiters) + ")"
    return F.split(t, regex, -1), F.regexp_extract_all(t, F.lit(regex), F.lit(1))


def _lengths(parts: Column, n: Column) -> Column:
    return F.aggregate(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x))


def cell_text(n: float) -> str:
    """A number that is written out, as text."""
    return str(int(n)) if n == int(n) and abs(n) < 1e15 else format(Decimal(repr(n)), "f")


def _around(t: object, delimiter: object, instance: object, any_case: bool, at_end: bool, otherwise: object, after: bool) -> Val:
    a, i = txt(t), num(instance)
    k = as_int(trunc0(i.v))
    if isinstance(delimiter, Val):
        return _around_column(a, txt(delimiter), k, i.e, bool(any_case), at_end, otherwise, after)
    given = list(delimiter) if isinstance(delimiter, list | tuple) else [delimiter]
    given = [d if isinstance(d, str) else cell_text(float(d)) for d in given]
    given = sorted(given, key=lambda d: -len(d)) if not after else given
    useful = [d for d in given if d]
    bad = (k == 0) | (F.abs(k) > F.length(a.v))
    if not after:
        bad = bad & (a.v != "")
    if len(useful) < len(given) if not after else not useful:  # an empty delimiter matches at once
        found = F.when(k > 0, a.v if after else F.lit("")).otherwise(F.lit("") if after else a.v)
        return guarded("text", found, first_error(a.e, i.e, F.when(bad, F.lit(VALUE))))
    parts, seps = _hits(a.v, useful, any_case)
    count = F.size(seps)
    place = F.when(k > 0, k).otherwise(count + k + 1)
    begin = _lengths(parts, place) + _lengths(seps, place - 1)
    stop = begin + F.length(F.coalesce(F.get(seps, place - 1), F.lit("")))
    value = F.substring(a.v, stop + 1, F.length(a.v)) if after else F.substring(a.v, F.lit(1), begin)
    miss = (place < 1) | (place > count)
    if at_end:
        edge = F.when(k > 0, place == count + 1).otherwise(place == 0)
        whole = F.when(k > 0, F.lit("") if after else a.v).otherwise(a.v if after else F.lit(""))
        value, miss = F.when(edge, whole).otherwise(value), miss & ~edge
    if not after:
        miss, value = miss & (a.v != ""), F.when(a.v == "", "").otherwise(value)
    err = first_error(a.e, i.e, F.when(bad, F.lit(VALUE)))
    if otherwise is None:
        return guarded("text", value, first_error(err, F.when(miss, F.lit(NA))))
    other = txt(otherwise)
    return guarded("text", F.when(miss, other.v).otherwise(value), first_error(err, None if other.e is None else F.when(miss, other.e)))


def _around_column(a: Val, d: Val, k: Column, other_error: Column | None, any_case: bool, at_end: bool, otherwise: object, after: bool) -> Val:
    """Text around the k-th hit of a delimiter that is a column; an empty one matches at once."""
    regex = F.concat(F.lit("(?iu)(" if any_case else "("), _quote(d.v), F.lit(")"))
    parts, count = F.split(a.v, regex, -1), F.size(F.split(a.v, regex, -1)) - 1
    place = F.when(k > 0, k).otherwise(count + k + 1)
    seps = F.regexp_extract_all(a.v, regex, F.lit(1))
    begin = _lengths(parts, place) + _lengths(seps, place - 1)
    stop = begin + F.length(F.coalesce(F.get(seps, place - 1), F.lit("")))
    value = F.substring(a.v, stop + 1, F.length(a.v)) if after else F.substring(a.v, F.lit(1), begin)
    empty = d.v == ""
    value = F.when(empty, F.when(k > 0, a.v if after else F.lit("")).otherwise(F.lit("") if after else a.v)).otherwise(value)
    miss = ~empty & ((place < 1) | (place > count))
    if at_end:
        edge = F.when(k > 0, place == count + 1).otherwise(place == 0)
        value = F.when(~empty & edge, F.when(k > 0, F.lit("") if after else a.v).otherwise(a.v if after else F.lit(""))).otherwise(value)
        miss = miss & ~edge
    bad = (k == 0) | (F.abs(k) > F.length(a.v))
    if not after:
        bad, miss = (bad & (a.v != "")) | (k == 0), miss & (a.v != "")
        value = F.when(a.v == "", "").otherwise(value)
    err = first_error(a.e, d.e, other_error, F.when(bad, F.lit(VALUE)))
    if otherwise is None:
        return guarded("text", value, first_error(err, F.when(miss, F.lit(NA))))
    other = txt(otherwise)
    return guarded("text", F.when(miss, other.v).otherwise(value), first_error(err, None if other.e is None else F.when(miss, other.e)))


def textafter(t: object, delimiter: object, instance: object = 1.0, match_mode: object = 0, match_end: object = 0, if_not_found: object = None) -> Val:
    return _around(t, delimiter, instance, bool(match_mode), bool(match_end), if_not_found, True)


def textbefore(t: object, delimiter: object, instance: object = 1.0, match_mode: object = 0, match_end: object = 0, if_not_found: object = None) -> Val:
    if match_mode not in (0, 1) or match_end not in (0, 1):
        return error(VALUE)
    return _around(t, delimiter, instance, bool(match_mode), bool(match_end), if_not_found, False)


def textsplit(t: object, columns: object = None, rows: object = None, ignore_empty: bool = False, match_mode: int = 0, pad: str = NA) -> Val:
    """A grid of text: array<array<string>> with short rows padded."""
    a = txt(t)

    def cut(x: Column, delimiters: object) -> Column:
        if delimiters is None:
            return F.array(x)
        given = [delimiters] if isinstance(delimiters, str) else sorted(delimiters, key=lambda d: -len(d))
        parts = F.split(x, ("(?iu)" if match_mode else "") + "|".join(re.escape(d) for d in given), -1)
        return F.filter(parts, lambda p: p != "") if ignore_empty else parts

    grid = F.transform(cut(a.v, rows), lambda r: cut(r, columns))
    wide = F.array_max(F.transform(grid, F.size))
    padded = F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(pad), wide - F.size(r))))
    empty = [d for d in ([columns] if isinstance(columns, str) else columns or []) + ([rows] if isinstance(rows, str) else rows or []) if d == ""]
    return Val("grid", padded, first_error(a.e, F.lit(VALUE) if empty else None))


FUNCTIONS |= {"TEXTAFTER": textafter, "TEXTBEFORE": textbefore, "TEXTSPLIT": textsplit}


def value(x: object) -> Val:
    """Text as a number: separators, $, %, brackets, exponents, ISO and US dates, times, mixed fractions."""
    a = as_val(x)
    if a.kind != "text":
        return num(a) if a.kind != "bool" else error(VALUE)
    t = F.trim(a.v)
    wrapped = t.rlike(r"^\(.*\)$")
    body = F.when(wrapped, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    share = body.rlike(r"%$")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, "%$", ""), r"^([+-]?)\s*\$\s*", "$1"))
    grouped = body.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?$")
    body = F.when(grouped, F.replace(body, F.lit(","), F.lit(""))).otherwise(body)
    plain_ = body.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    n = F.when(plain_, body.try_cast("double")) * F.when(wrapped, -1.0).otherwise(1.0) / F.when(share, 100.0).otherwise(1.0)
    us = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    iso_text = F.when(t.rlike(us), F.format_string("%s-%s-%s", F.regexp_extract(t, us, 3), F.lpad(F.regexp_extract(t, us, 1), 2, "0"), F.lpad(F.regexp_extract(t, us, 2), 2, "0"))).when(
        t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), t
    )
    day = F.datediff(iso_text.try_cast("date"), F.lit("1899-12-30").cast("date"))
    day = F.when(day > 60, day).otherwise(day - 1).cast("double")
    clock = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$"
    part = lambda k: F.coalesce(F.regexp_extract(t, clock, k).try_cast("double"), F.lit(0.0))
    time = F.when(t.rlike(clock), (part(1) * 3600 + part(2) * 60 + part(3)) / 86400)
    mixed = r"^([+-]?)([0-9]+) ([0-9]+)/([0-9]+)$"
    m = lambda k: F.regexp_extract(t, mixed, k).try_cast("double")
    fraction = F.when(t.rlike(mixed), (m(2) + F.try_divide(m(3), m(4))) * F.when(F.regexp_extract(t, mixed, 1) == "-", -1.0).otherwise(1.0))
    found = F.when(a.v.isNull(), F.lit(0.0)).otherwise(F.coalesce(n, day, time, fraction))
    return guarded("number", found, first_error(a.e, F.when(found.isNull(), F.lit(VALUE))))


FUNCTIONS["VALUE"] = value

_NUMBER_FORMAT = re.compile(r'^(?P<head>(?:[$ ()€£-]|"[^"]*")*)(?P<whole>[#0,]+)(?:\.(?P<part>[0#]+))?(?P<share>%*)(?P<tail>(?:[ ()]|"[^"]*")*)$')
_DATE_TOKENS = re.compile(r'yyyy|yy|mmmm|mmm|mm|m|dddd|ddd|dd|d|[-/., ]|"[^"]*"', re.I)
#: Date tokens and their Spark patterns.
_DATE_PATTERNS = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d"}


def format_text(x: object, pattern: str) -> Val:
    """TEXT with a literal format: General, @, number formats of 0 # , . %, and dates of y m d."""
    a = as_val(x)
    if pattern == "" or pattern.lower() == "general" or pattern == "@":
        return txt(a) if pattern else guarded("text", F.lit(""), a.e)
    m = _NUMBER_FORMAT.match(pattern)
    if m:
        n = num(a)
        if a.kind == "text":  # text that is no number stays as it is
            n, words = Val("number", n.v, None), txt(a)
            shown = format_text(n, pattern)
            return guarded("text", F.when(num(a).e.isNull(), shown.v).otherwise(words.v), a.e)
        part = m["part"] or ""
        p, least = 10.0 ** len(part), m["whole"].count("0")
        text_of = lambda s: "".join(x.strip('"') for x in re.findall(r'"[^"]*"|.', s))

        def show(rounded: Column, whole: Column) -> Column:
            """The text of a number whose last shown place is 1; whole is what stands before the point."""
            whole = F.when(F.length(whole) < least, F.lpad(whole, least, "0")).otherwise(whole) if least > 1 else whole
            if not least:
                whole = F.when(whole == "0", "").otherwise(whole)
            if "," in m["whole"]:
                whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
            shown = whole
            if part:
                digits = F.lpad((rounded % p).cast("bigint").cast("string"), len(part), "0")
                optional = len(part) - len(part.rstrip("#"))
                if optional:
                    digits = F.regexp_replace(digits, "0{1,%d}$" % optional, "")
                shown = F.concat(whole, F.lit("."), digits)
            sign = F.when((n.v < 0) & (rounded > 0), "-").otherwise("")
            return F.concat(sign, F.lit(text_of(m["head"])), shown, F.lit(m["share"] + text_of(m["tail"])))

        def before_point(rounded: Column) -> Column:
            return bind([rounded, down(rounded / p)], lambda r, w: show(r, F.when(w < 1e15, F.when(w < 1e15, w).cast("bigint").cast("string")).otherwise(F.replace(F.format_number(w, 0), F.lit(","), F.lit("")))))

        rounded = down(r15(F.abs(n.v)) * (100.0 ** len(m["share"])) * p + 0.5)
        return guarded("text", bind([rounded], before_point), n.e)
    tokens = _DATE_TOKENS.findall(pattern)
    if "".join(tokens) != pattern:
        return error(VALUE)
    n = num(a)
    java = "".join(_DATE_PATTERNS.get(t.lower(), t if re.match(r"[-/., ]", t) else "'" + t.strip('"') + "'") for t in tokens)
    day = F.floor(n.v)
    date = F.date_add(F.lit("1899-12-30").cast("date"), F.when((day >= 61) & (day <= 2958465), day).when((day >= 0) & (day < 61), day + 1).cast("int"))
    return guarded("text", F.date_format(date, java), first_error(n.e, F.when((day < 0) | (day > 2958465), F.lit(VALUE))))


FUNCTIONS["TEXT"] = format_text
