"""Worksheet functions on values whose results are fixed by their definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

import tabulon.functions.dates  # noqa: F401
import tabulon.functions.finance as M
import tabulon.functions.logic as L
import tabulon.functions.math  # noqa: F401
import tabulon.functions.text as T
from tabulon.functions.values import FUNCTIONS, error, text
from tabulon.operators import criteria, lookup, ordering, reshape


def f(name, *args):
    return FUNCTIONS[name](*args)


CASES = [
    (lambda: L.add(True, "2"), 3.0), (lambda: L.add("x", 1.0), "#VALUE!"), (lambda: L.divide(1.0, None), "#DIV/0!"),
    (lambda: L.equal(0.1 + 0.2, 0.3), True), (lambda: L.equal("A", "a"), True), (lambda: L.equal(2.0, "2"), False), (lambda: L.equal(None, ""), True),
    (lambda: L.less("a", True), True), (lambda: L.less(9.0, "a"), True), (lambda: L.concatenate(1.0, True), "1TRUE"), (lambda: L.concatenate(0.00001, ""), "0.00001"),
    (lambda: L.if_(True, "y", "n"), "y"), (lambda: L.ifs(False, 1.0, True, 2.0), 2.0), (lambda: L.ifs(True, 1.0, True, error("#NUM!")), "#NUM!"), (lambda: L.ifs(False, 1.0), "#N/A"),
    (lambda: L.and_(None), True), (lambda: L.or_(None), False), (lambda: L.and_("x"), "#VALUE!"), (lambda: L.xor(True, True, True), True), (lambda: L.choose(2.9, "a", "b"), "b"),
    (lambda: f("ROUND", 2.15, 1.0), 2.2), (lambda: f("ROUND", -2.5), -3.0), (lambda: f("ROUND", 1234.0, -2.0), 1200.0), (lambda: f("ROUNDUP", 1.1, 0.0), 2.0), (lambda: f("ROUNDDOWN", -1.19, 1.0), -1.1),
    (lambda: f("INT", -1.5), -2.0), (lambda: f("MOD", -3.0, 2.0), 1.0), (lambda: f("MOD", 3.0, 0.0), "#DIV/0!"), (lambda: f("CEILING", 1.2, 0.1), 1.2), (lambda: f("FLOOR", 2.0, -1.0), "#NUM!"),
    (lambda: f("POWER", 0.0, 0.0), "#NUM!"), (lambda: f("SQRT", -1.0), "#NUM!"), (lambda: f("N", "7"), 0.0), (lambda: f("CEILING.MATH", -5.5, 2.0, 1.0), -6.0), (lambda: f("FLOOR.MATH", -5.5, 2.0, 1.0), -4.0),
    (lambda: f("DATE", 1900.0, 2.0, 29.0), 60.0), (lambda: f("DATE", 2008.0, 1.0, 1.0), 39448.0), (lambda: f("DATE", 108.0, 1.0, 2.0), 39449.0), (lambda: f("DATE", 2008.0, 14.0, 2.0), 39846.0), (lambda: f("DATE", 10000.0, 1.0, 1.0), "#NUM!"),
    (lambda: f("DAY", 60.0), 29.0), (lambda: f("DAY", 0.0), 0.0), (lambda: f("YEAR", -1.0), "#NUM!"), (lambda: f("EDATE", 40574.0, 1.0), 40602.0), (lambda: f("EOMONTH", 40544.0, -3.0), 40482.0),
    (lambda: f("WEEKDAY", 39492.0), 5.0), (lambda: f("WEEKDAY", 39492.0, 3.0), 3.0), (lambda: f("WEEKNUM", 40977.0, 2.0), 11.0), (lambda: f("ISOWEEKNUM", 40977.0), 10.0), (lambda: f("ISOWEEKNUM", 1.0), 52.0),
    (lambda: f("NETWORKDAYS", 41183.0, 41334.0), 110.0), (lambda: f("NETWORKDAYS", 41183.0, 41334.0, [41235.0, 41247.0, 41295.0]), 107.0), (lambda: f("NETWORKDAYS.INTL", 1.0, 50.0, "1111111"), 0.0), (lambda: f("WORKDAY.INTL", 1.0, 5.0, "1111111"), "#VALUE!"),
    (lambda: f("WORKDAY", 39722.0, 151.0), 39933.0), (lambda: f("WORKDAY", 39722.0, 151.0, [39778.0, 39786.0, 39834.0]), 39938.0), (lambda: f("DAYS360", 40573.0, 40575.0), 1.0), (lambda: f("YEARFRAC", 40909.0, 41120.0), 0.58055556), (lambda: f("YEARFRAC", 40909.0, 41120.0, 1.0), 0.57650273),
    (lambda: f("PROPER", "don't école"), "Don'T éCole"), (lambda: f("UPPER", "straße"), "STRAßE"), (lambda: f("TRIM", "  a  b "), "a b"), (lambda: f("LEFT", "abc", -1.0), "#VALUE!"), (lambda: f("MID", "abc", 0.0, 1.0), "#VALUE!"), (lambda: f("LEN", "😀a"), 2.0),
    (lambda: T.find("", "abc", 4.0), 4.0), (lambda: T.find("C", "abc"), "#VALUE!"), (lambda: T.search("B?", "abc"), 2.0), (lambda: T.search("~?", "a?c"), 2.0), (lambda: T.substitute("a-b-c", "-", "+", 2.0), "a-b+c"), (lambda: f("REPLACE", "abcdef", 2.0, 3.0, "*"), "a*ef"),
    (lambda: T.textafter("a-b-c", "-", -1.0), "c"), (lambda: T.textbefore("a-b-c", "-", 2.0), "a-b"), (lambda: T.textafter("abc", "-"), "#N/A"), (lambda: T.textbefore("abc", "-", 0.0), "#VALUE!"), (lambda: T.textjoin(",", True, "a", "", None, "b"), "a,b"),
    (lambda: f("CHAR", 128.0), "€"), (lambda: f("CODE", "€"), 128.0), (lambda: f("CODE", ""), "#VALUE!"), (lambda: f("UNICHAR", 55296.0), "#N/A"), (lambda: f("UNICODE", "😀"), 128512.0), (lambda: f("REPT", "ab", 2.9), "abab"), (lambda: f("REPT", "a", 40000.0), "#VALUE!"),
    (lambda: T.value("$1,234.50"), 1234.5), (lambda: T.value("(5)"), -5.0), (lambda: T.value("50%"), 0.5), (lambda: T.value("1 1/2"), 1.5), (lambda: T.value("2008-01-01"), 39448.0), (lambda: T.value("x"), "#VALUE!"), (lambda: T.value("12:00"), 0.5),
    (lambda: T.format_text(1234.567, "#,##0.00"), "1,234.57"), (lambda: T.format_text(0.285, "0.0%"), "28.5%"), (lambda: T.format_text(-0.001, "0.00"), "0.00"), (lambda: T.format_text(39448.0, "yyyy-mm-dd"), "2008-01-01"), (lambda: T.format_text(7.0, "000"), "007"), (lambda: T.format_text(5.0, "$0.00"), "$5.00"),
    (lambda: M.pmt(0.08 / 12, 10.0, 10000.0), -1037.0320893591606), (lambda: M.fv(0.06 / 12, 10.0, -200.0, -500.0, 1.0), 2581.4033740601208), (lambda: M.pv(0.08 / 12, 240.0, 500.0, 0.0), -59777.14585118644), (lambda: M.nper(0.01, -100.0, -1000.0, 10000.0, 1.0), 59.67386567),
    (lambda: M.rate(48.0, -200.0, 8000.0), 0.0077014725), (lambda: M.ipmt(0.1 / 12, 1.0, 36.0, 8000.0), -66.66666667), (lambda: M.cumipmt(0.09 / 12, 360.0, 125000.0, 13.0, 24.0, 0.0), -11135.23213), (lambda: M.cumprinc(0.09 / 12, 360.0, 125000.0, 13.0, 24.0, 0.0), -934.1071234),
    (lambda: M.effect(0.0525, 4.0), 0.05354266737), (lambda: M.nominal(0.053543, 4.0), 0.05250032), (lambda: M.pduration(0.025, 2000.0, 2200.0), 3.859866163), (lambda: M.rri(96.0, 10000.0, 11000.0), 0.0009933074), (lambda: M.npv(0.1, -10000.0, 3000.0, 4200.0, 6800.0), 1188.443412),
    (lambda: f("INT", 1e20), 1e20), (lambda: f("INT", -1e20), -1e20), (lambda: f("TRUNC", 1e19, 1.0), 1e19), (lambda: f("ROUND", 1e300, 20.0), 1e300), (lambda: f("ROUNDUP", 1e17, 2.0), 1e17), (lambda: f("MOD", 1e20, 3.0), 0.0), (lambda: f("FLOOR", 9007199254740991.0, 2.0), 9007199254740990.0), (lambda: f("CEILING", -7.0, -2.0), -8.0), (lambda: f("FLOOR", -7.0, 2.0), -8.0),
    (lambda: f("LEFT", "abc", 1e10), "abc"), (lambda: f("RIGHT", "abc", 1e10), "abc"), (lambda: f("MID", "abc", 2.0, 1e10), "bc"), (lambda: f("MID", "abc", 1e10, 1.0), ""), (lambda: f("REPLACE", "abc", 2.0, 1e10, "z"), "az"), (lambda: T.find("a", "abc", 1e10), "#VALUE!"), (lambda: T.substitute("a\x00b", "b", "c", 1.0), "a\x00c"),
    (lambda: L.concatenate(1e22, ""), "10000000000000000000000"), (lambda: L.concatenate(-1.5e-7, ""), "-0.00000015"), (lambda: L.concatenate(123456789012345680.0, ""), "123456789012345680"), (lambda: L.concatenate(12345678.25, ""), "12345678.25"), (lambda: T.format_text(12345.0, "000"), "12345"), (lambda: T.format_text(1234567.0, "#,#00"), "1,234,567"), (lambda: T.format_text(1e18, "0"), "1000000000000000000"), (lambda: T.format_text(1e40, "#,##0"), "10," + ",".join(["000"] * 13)), (lambda: T.format_text(-1234.5, "$#,##0.0#"), "-$1,234.5"),
    (lambda: L.less(None, ""), True), (lambda: L.less(text(F.lit(None).cast("string")), "a"), True), (lambda: L.less("a", text(F.lit(None).cast("string"))), False), (lambda: L.less(-1.0, text(F.lit(None).cast("string"))), True), (lambda: L.less(True, None), False),
    (lambda: f("EDATE", 1.0, -1.0), "#NUM!"), (lambda: f("EOMONTH", 1.0, -1.0), "#NUM!"), (lambda: f("EDATE", 40574.0, 1e20), "#NUM!"), (lambda: f("DATE", 2000.0, 1e20, 1.0), "#NUM!"), (lambda: f("NETWORKDAYS", 1e20, 2.0), "#NUM!"), (lambda: f("EDATE", 31.0, 1.0), 60.0), (lambda: f("YEAR", 60.5), 1900.0), (lambda: f("MONTH", 61.0), 3.0),
    (lambda: L.error_type(error("#N/A")), 7.0), (lambda: L.type_("x"), 2.0), (lambda: f("ISBLANK", text(F.lit(None).cast("string"))), True), (lambda: L.iferror(L.divide(1.0, 0.0), "z"), "z"), (lambda: f("ISERR", error("#N/A")), False),
]


def test_scalar_functions(spark):
    made = [make() for make, _ in CASES]
    for at in range(0, len(made), 25):
        part = made[at : at + 25]
        row = spark.range(1).select(*[c for k, v in enumerate(part) for c in (v.column(f"v{k}"), v.error(f"e{k}"))]).first()
        for k, (_, want) in enumerate(CASES[at : at + 25]):
            value, err = row[f"v{k}"], row[f"e{k}"]
            if isinstance(want, str) and want.startswith("#"):
                assert err == want, (at + k, value, err, want)
            elif isinstance(want, float):
                assert err is None and math.isclose(value, want, rel_tol=1e-7, abs_tol=1e-9), (at + k, value, err, want)
            else:
                assert err is None and value == want, (at + k, value, err, want)


def test_criteria(spark):
    rows = spark.createDataFrame([(1.0, "Apple"), (5.0, "banana"), (None, None), (5.5, "5"), (2.0, "")], "n double, t string")
    n, t = F.col("n"), F.col("t")
    count = lambda c: rows.agg(F.count_if(c)).first()[0]
    assert count(criteria.criterion(n, "number", ">=5")) == 2
    assert count(criteria.criterion(n, "number", "<>5")) == 4
    assert count(criteria.criterion(t, "text", "a*")) == 1
    assert count(criteria.criterion(t, "text", "<>APPLE")) == 4
    assert count(criteria.criterion(t, "text", 5)) == 1
    assert count(criteria.criterion(t, "text", "")) == 2
    assert count(criteria.criterion(t, "text", "=")) == 1


def test_nearest_lookup_and_order(spark):
    keys = spark.createDataFrame([(k, float(v)) for k, v in enumerate([5, 10, 10.5, 99, 1])] + [(9, None)], "id long, k double")
    table = spark.createDataFrame([(2.0, "a"), (10.0, "b"), (50.0, "c")], "edge double, name string")
    got = {r["id"]: (r["found"], r["error"]) for r in lookup.lookup_nearest(keys, "k", table, "edge", "name").collect()}
    assert got == {0: ("a", None), 1: ("b", None), 2: ("b", None), 3: ("c", None), 4: (None, "#N/A"), 9: (None, "#N/A")}
    up = {r["id"]: r["found"] for r in lookup.lookup_nearest(keys, "k", table, "edge", "name", larger=True).collect()}
    assert up == {0: "b", 1: "b", 2: "c", 3: None, 4: "a", 9: None}
    numbered = ordering.with_ord(spark.range(500).repartition(7), F.desc("id")).collect()
    assert all(r["ord"] == 500 - r["id"] for r in numbered)


def test_reshaping(spark):
    grid = spark.createDataFrame([(1, "b", 2.0), (2, "A", None), (3, "a", 1.0), (4, "b", 2.0)], "ord long, t string, n double")
    assert [r["ord"] for r in reshape.sort_rows(grid, "n", -1).collect()] == [1, 4, 3, 2]
    assert sorted(r["ord"] for r in reshape.unique_rows(grid, ["t"]).collect()) == [1, 2]
    assert reshape.unique_rows(grid, ["t", "n"], once=True).count() == 2
    assert [r["t"] for r in reshape.choose_rows(grid, -1, 2).orderBy("ord").collect()] == ["b", "A"]
    with pytest.raises(ValueError):
        reshape.choose_columns(grid, 3)
    assert reshape.expand(grid, 6, {"n": 0.0}).where("n = 0").count() == 2
    assert [r["c2"] for r in reshape.wrap_rows(grid.select("ord", F.col("n").alias("value")), 2, -1.0).orderBy("ord").collect()] == [-1.0, 2.0]


def test_cash_flow_rates_against_bisection(spark):
    def worth(rate, dated):
        return sum(v / (1 + rate) ** t for v, t in dated)

    def bisection(dated):
        low, high = -0.999, 1e4
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if worth(middle, dated) > 0 else (low, middle)
        return (low + high) / 2

    rng = random.Random(7)
    rows = [[(-386697.56, 0.0), (73919.63, 257.0), (80726.25, 1814.0)]]  # the secant cycles on this one
    rows += [[(-rng.uniform(50, 150), 0.0), *[(rng.uniform(20, 90), float(d)) for d in sorted(rng.sample(range(1, 2500), 3))]] for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(rows)), "id int, flows array<struct<value: double, date: double>>")
    got = frame.select("id", M.xirr(F.col("flows")).v.alias("xirr"), M.irr(F.col("flows.value")).v.alias("irr"))
    for r in got.collect():
        flows = rows[r["id"]]
        assert r["xirr"] == pytest.approx(bisection([(v, d / 365) for v, d in flows]), abs=1e-7)
        assert r["irr"] == pytest.approx(bisection([(v, k) for k, (v, _) in enumerate(flows)]), abs=1e-7)
    same_day = spark.createDataFrame([([(-1.0, 0.0), (2.0, 0.0)],)], "flows array<struct<value: double, date: double>>")
    assert same_day.select(M.xirr(F.col("flows")).v.alias("v")).first()["v"] is None


def test_wildcard_lookup_of_mixed_keys(spark):
    table = spark.createDataFrame([(1, "ab"), (2, "AC"), (3, "b*"), (4, "ab")], "at int, t string")
    keys = spark.createDataFrame([("a?",), ("AB",), ("b~*",), ("zz",), (None,), ("*c",)], "k string")
    for last, want in ((False, {"a?": 1, "AB": 1, "b~*": 3, "zz": None, None: None, "*c": 2}), (True, {"a?": 4, "AB": 4, "b~*": 3, "zz": None, None: None, "*c": 2})):
        got = lookup.lookup_wildcard(keys, "k", table, "t", "at", "at", last=last).collect()
        assert {r["k"]: r["found"] for r in got} == want and all((r["error"] == "#N/A") == (r["found"] is None) for r in got)


def test_nearest_lookup_ties_and_types(spark):
    table = spark.createDataFrame([(1, 2**60 + 1), (2, 2**60 + 3), (3, 2**60 + 3), (4, None)], "at int, t bigint")
    keys = spark.createDataFrame([(2**60,), (2**60 + 1,), (2**60 + 2,), (2**60 + 9,), (None,)], "k bigint")
    near = lambda **o: {r["k"]: r["found"] for r in lookup.lookup_nearest(keys, "k", table, "t", "at", "at", **o).collect()}
    assert near() == {2**60: None, 2**60 + 1: 1, 2**60 + 2: 1, 2**60 + 9: 3, None: None}
    assert near(larger=True, exact_first=True) == {2**60: 1, 2**60 + 1: 1, 2**60 + 2: 2, 2**60 + 9: None, None: None}
    none = lookup.lookup_nearest(keys, "k", table.where("false"), "t", "at", "at").collect()
    assert all(r["found"] is None and r["error"] == "#N/A" for r in none)


def test_scan_without_groups(spark):
    from pyspark.sql import functions as F

    from tabulon.operators.lambdas import scan

    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 5 <> 0 THEN CAST(id % 11 AS DOUBLE) END AS x").repartition(9)
    total, high = 0.0, None
    want = {}
    for k in range(500):
        if k % 5:
            total += k % 11
            high = max(high or 0, k % 11)
        want[k] = (total if k else None, high)
    for how, at in (("+", 0), ("max", 1)):
        got = {r["id"]: r["running"] for r in scan(rows, "x", how, [], ["id"]).select("id", F.col("running")).collect()}
        assert got == {k: v[at] for k, v in want.items()}
