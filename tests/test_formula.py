"""Formula text through the parser and Spark."""

import math

import pytest

from tabulon.functions.values import number, text
from tabulon.plans.formula import FormulaError, compile_formula, with_formula

CASES = [
    ("=1+2*3", 7.0), ("=-2^2", 4.0), ("=2^3^2", 512.0), ("=10%", 0.1), ("=50%%", 0.005), ('="a"&1&TRUE', "a1TRUE"), ("=1=1", True), ('="A"="a"', True), ("=1/0", "#DIV/0!"), ("=#N/A", "#N/A"),
    ('=IF(1>2,"x","y")', "y"), ("=LET(x,2,y,x*3,x+y)", 8.0), ("=LAMBDA(a,b,a*b)(3,4)", 12.0), ("=LAMBDA(a,b,IF(ISOMITTED(b),a,b))(3,)", 3.0), ("=LAMBDA(a,a)", "#CALC!"), ("=LAMBDA(a,a)(1,2)", "#VALUE!"),
    ("=NOSUCH(1)", "#NAME?"), ("=nosuch", "#NAME?"), ("=IFERROR(1/0,5)", 5.0), ('=LEN("say ""hi""")', 8.0), ("=LET(f,LAMBDA(x,x+1),f(f(1)))", 3.0), ("=ROUND(2.345,2)", 2.35), ("=(1+2)*-3", -9.0), ("=ABS()", "#VALUE!"),
    ("=DATE(1900,2,29)", 60.0), ('=TEXT(1234.5,"#,##0.0")', "1,234.5"), ("=_xlfn.LET(a,1,a)", 1.0),
]


def test_formulas(spark):
    made = [compile_formula(t) for t, _ in CASES]
    row = spark.range(1).select(*[c for k, v in enumerate(made) for c in (v.column(f"v{k}"), v.error(f"e{k}"))]).first()
    for k, (formula, want) in enumerate(CASES):
        value, err = row[f"v{k}"], row[f"e{k}"]
        if isinstance(want, str) and want.startswith("#"):
            assert err == want, (formula, value, err)
        elif isinstance(want, float):
            assert err is None and math.isclose(value, want), (formula, value, err)
        else:
            assert err is None and value == want, (formula, value, err)


def test_column_delimiters_and_holidays(spark):
    rows = spark.createDataFrame([("a-b-c", "-", 2.0, 41183.0), ("a+b", "+", -1.0, 1.0), ("", "x", 1.0, 5.0), ("ab", "", 1.0, 9.0), ("a.b", "z", 1.0, 3.0)], "t string, d string, k double, s double")
    names = {"t": text("t"), "d": text("d"), "k": number("k"), "s": number("s")}
    pick = lambda f: [r["r"] if r["r_error"] is None else r["r_error"] for r in with_formula(rows, "r", f, names).collect()]
    assert pick("=TEXTAFTER(t,d,k)") == ["c", "b", "#VALUE!", "ab", "#N/A"]
    assert pick("=TEXTBEFORE(t,d,k)") == ["a-b", "a", "", "", "#N/A"]
    assert pick("=TEXTAFTER(t,d,k,0,1,9)") == ["c", "b", "#VALUE!", "ab", ""]
    assert pick("=NETWORKDAYS(s,s+6,s)") == [4.0, 5.0, 4.0, 4.0, 4.0]
    assert pick("=NETWORKDAYS(s,s+6,t)") == ["#VALUE!"] * 5


def test_formula_over_a_table(spark):
    rows = spark.createDataFrame([(10.0, 4.0, "a"), (1.0, 0.0, None)], "p double, q double, t string")
    got = with_formula(rows, "r", '=IF(q=0,"none: "&t,p/q)', {"p": number("p"), "q": number("q"), "t": text("t")}).collect()
    assert [r["r"] for r in got] == ["2.5", "none: "]


def test_bad_text():
    for bad in ("=1+", "=(1", "=1 2", "=SUM(1;2)"):
        with pytest.raises(FormulaError):
            compile_formula(bad)


def test_plans_stay_linear(spark):
    """Nested calls and LET do not repeat their arguments."""
    deep = "2011"
    for _ in range(3):
        deep = f"YEAR(EDATE(DATE({deep},1,15),12))"
    names = ["v" + c for c in "abcdefghijklmnop"]
    chain = "=LET(va,ROUND(q,1)," + "".join(f"{b},IF({a}>0,{a}+{a},{a}*{a})," for a, b in zip(names, names[1:], strict=False)) + names[-1] + ")"
    got = spark.range(1).selectExpr("1.0D AS q")
    assert with_formula(got, "r", "=" + deep, {}).first()["r"] == 2014.0
    assert with_formula(got, "r", chain, {"q": number("q")}).first()["r"] == 2.0**15
