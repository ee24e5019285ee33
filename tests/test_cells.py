"""The cell lane: workbooks, references, arrays and LAMBDA forms, and the case runner."""

import json
import os

import pytest

from tabulon.cells.evaluator import Workbook
from tabulon.cells.values import Err
from tabulon.plans.cell_queries import CASES_DIR
from tabulon.plans.parser import FormulaError, column_letters, column_number, parse, parse_ref
from tabulon.plans.verify import Engine, alike, formulas, judge, main, verdicts
from tabulon.sources.cases import decode, encode, read_cases, workbook

GRID = {"A1": 3, "A2": 1, "A3": 2, "B1": "x", "B2": "y", "B3": "X", "C1": True, "C3": {"error": "#N/A"}, "D1": {"formula": "=A1+A2"}, "D2": {"formula": "=D1*2"}, "E1": "", "E2": None, "E3": "7"}


def engine(cells=GRID, names=(), **options):
    return Engine(workbook({"sheets": [{"name": "Sheet1", "cells": cells}, {"name": "My sheet", "cells": {"A1": 42}}], "names": list(names)}), **options)


def n(*rows):
    return [[float(c) if isinstance(c, int) and not isinstance(c, bool) else c for c in row] for row in rows]


CASES = [
    ("=SUM(A1:A3)", 6.0), ("=D2", 8.0), ("='My sheet'!A1", 42.0), ("=SUM(A1:B2 A2:C3)", 1.0), ("=A1:A2 B1:B2", Err("#NULL!")), ("=Nope!A1", Err("#REF!")), ("={1,2;3,4}", n([1, 2], [3, 4])), ("=SUM({1,2;3,4})", 10.0),
    ("=SUM(TRUE,\"2\")", 3.0), ("=SUM(C1,E3)", 0.0), ("=SUM(C1:C3)", Err("#N/A")), ("=COUNT(A1:E3)", 5.0), ("=COUNTA(A1:E3)", 12.0), ("=COUNTBLANK(A1:E3)", 4.0), ("=AVERAGE(E1:E2)", Err("#DIV/0!")), ("=PRODUCT(E1:E3)", 0.0), ("=MAX(A1:A3)-MIN(A1:A3)", 2.0),
    ("=SUMIF(A1:A3,\">1\")", 5.0), ("=SUMIF(B1:B3,\"x\",A1)", 5.0), ("=SUMIFS(A1:A3,B1:B3,\"x\",A1:A3,\"<3\")", 2.0), ("=SUMIFS(A1:A3,B1:B2,\"x\")", Err("#VALUE!")), ("=COUNTIF(B1:B3,\"?\")", 3.0), ("=COUNTIF(C1:C3,\"#N/A\")", 1.0), ("=COUNTIF(E1:E3,\"\")", 2.0), ("=COUNTIF(E1:E3,7)", 1.0), ("=SUMIF(E1:E3,7,A1:A3)", 0.0), ("=COUNTIFS(A1:A3,\"<>1\",B1:B3,\"x*\")", 2.0), ("=AVERAGEIF(A1:A3,\">1\")", 2.5), ("=AVERAGEIFS(A1:A3,B1:B3,\"z\")", Err("#DIV/0!")),
    ("=SUMPRODUCT(--(A1:A3>1),A1:A3)", 5.0), ("=SUMPRODUCT(A1:A3*{1;2;3})", 11.0), ("=SUMPRODUCT(A1:A3,A1:B3)", Err("#VALUE!")),
    ("=VLOOKUP(2,{1,\"a\";2,\"b\";2,\"c\";4,\"d\"},2)", "c"), ("=VLOOKUP(2,{1,\"a\";2,\"b\";2,\"c\"},2,FALSE)", "b"), ("=VLOOKUP(0,{1,\"a\"},2)", Err("#N/A")), ("=VLOOKUP(1,{1,2},3)", Err("#REF!")), ("=HLOOKUP(2,{1,2,3;4,5,6},2)", 5.0), ("=HLOOKUP(2,{1,2;3,4},0)", Err("#VALUE!")), ("=VLOOKUP(\"b*\",{\"ab\",1;\"BC\",2},2,FALSE)", 2.0),
    ("=XLOOKUP(4,{1;3;5},{\"a\";\"b\";\"c\"},\"no\",-1)", "b"), ("=XLOOKUP(4,{1;3;5},{\"a\";\"b\";\"c\"},\"no\",1)", "c"), ("=XLOOKUP(4,{1;3;5},{\"a\";\"b\";\"c\"},\"no\")", "no"), ("=XLOOKUP(1,{1;1},{\"a\";\"b\"},,0,-1)", "b"), ("=XLOOKUP(\"?c\",{\"ab\";\"bc\"},{1;2},,2)", 2.0), ("=XLOOKUP(3,{1;3;5},{1,2;3,4;5,6},,0,2)", n([3, 4])), ("=XLOOKUP(3,{5;3;1},{1;2;3},,0,-2)", 2.0), ("=XLOOKUP(TRUE,{1;TRUE},{\"n\";\"b\"})", "b"), ("=XLOOKUP(1,{1;2},{1;2},,2,2)", Err("#VALUE!")),
    ("=INDEX({1,2;3,4},2,1)", 3.0), ("=INDEX({1,2;3,4},0,1)", Err("#REF!")), ("=INDEX({7,8,9},2)", 8.0), ("=MATCH(2,{1,2,2,5})", 3.0), ("=MATCH(3,{5;4;2},-1)", 1.0), ("=MATCH(\"b?\",{\"a\",\"bb\"},0)", 2.0), ("=CHOOSE(2.9,1,2)", 2.0),
    ("=FILTER({1,2;3,4},{TRUE;FALSE})", n([1, 2])), ("=FILTER({1,2,3},{0,1,1})", n([2, 3])), ("=FILTER({1,2},{FALSE,FALSE})", Err("#CALC!")), ("=FILTER({1},{0},\"none\")", "none"), ("=SORT({3;1;2})", n([1], [2], [3])), ("=SORT({3,1,2},1,-1,TRUE)", n([3, 2, 1])), ("=SORT({\"b\";TRUE;1;\"A\"},1,-1)", [[True], ["b"], ["A"], [1.0]]), ("=SORT(E1:E3,1,-1)", [["7"], [""], [None]]),
    ("=SORTBY({1;2;3},{3;1;2})", n([2], [3], [1])), ("=SORTBY({1,2,3},{3,1,2},-1)", n([1, 3, 2])), ("=SORTBY({1;2},{1;2;3})", Err("#VALUE!")), ("=UNIQUE({1;2;1})", n([1], [2])), ("=UNIQUE({1;2;1},FALSE,TRUE)", n([2])), ("=UNIQUE({1;1},FALSE,TRUE)", Err("#CALC!")), ("=UNIQUE({\"a\",\"A\",\"b\"},TRUE)", [["a", "b"]]),
    ("=TOCOL({1,2;3,4},0,TRUE)", n([1], [3], [2], [4])), ("=TOROW(A1:A3)", n([3, 1, 2])), ("=TOCOL(C1:C3,3)", [[True]]), ("=SEQUENCE(2,2,5,3)", n([5, 8], [11, 14])), ("=SEQUENCE(0)", Err("#CALC!")), ("=VSTACK({1,2},{3})", [[1.0, 2.0], [3.0, Err("#N/A")]]), ("=HSTACK({1;2},{3})", [[1.0, 3.0], [2.0, Err("#N/A")]]),
    ("=WRAPROWS({1,2,3},2,0)", n([1, 2], [3, 0])), ("=WRAPCOLS({1,2,3},2)", [[1.0, 3.0], [2.0, Err("#N/A")]]), ("=WRAPCOLS({1,2,3},9)", n([1], [2], [3])), ("=TAKE({1;2;3},-2)", n([2], [3])), ("=TAKE({1,2;3,4},1,1)", n([1])), ("=TAKE({1},0)", Err("#CALC!")), ("=DROP({1;2;3},1)", n([2], [3])), ("=DROP({1;2},2)", Err("#CALC!")), ("=DROP({1,2;3,4},,1)", n([2], [4])), ("=EXPAND({1},2,2,0)", n([1, 0], [0, 0])), ("=EXPAND({1;2},1)", Err("#VALUE!")), ("=EXPAND({1;2},,2)", [[1.0, Err("#N/A")], [2.0, Err("#N/A")]]),
    ("=CHOOSECOLS({1,2,3},-1,1)", n([3, 1])), ("=CHOOSEROWS({1;2;3},{3,1})", n([3], [1])), ("=CHOOSEROWS({1},2)", Err("#VALUE!")), ("=ROWS(1)", Err("#NAME?")), ("=SUM(RANDARRAY(3,4,2,2,TRUE))", 24.0), ("=RANDARRAY(1,1,3,2)", Err("#VALUE!")),
    ("=MAKEARRAY(2,2,LAMBDA(r,c,r*c))", n([1, 2], [2, 4])), ("=MAP({1,2},{3,4},LAMBDA(a,b,a+b))", n([4, 6])), ("=MAP({1,2},{3},LAMBDA(a,b,a+b))", [[4.0, Err("#N/A")]]), ("=SCAN(0,{1,2,3},LAMBDA(a,v,a+v))", n([1, 3, 6])), ("=SCAN(,{5,2},LAMBDA(a,v,a-v))", n([5, 3])), ("=REDUCE(1,{2,3},LAMBDA(a,v,a*v))", 6.0), ("=BYROW({1,2;3,4},LAMBDA(r,SUM(r)))", n([3], [7])), ("=BYROW({1,2;3,4},MAX)", n([2], [4])), ("=BYCOL({1,2;3,4},LAMBDA(c,SUM(c)))", n([4, 6])), ("=LAMBDA(x,x+1)(2)", 3.0), ("=LAMBDA(x,x)", Err("#CALC!")), ("=LET(a,2,b,a*3,a+b)", 8.0), ("=LAMBDA(x,y,ISOMITTED(y))(1,)", True),
    ("=IFERROR(C3,0)", 0.0), ("=ISBLANK(E2)", True), ("=ISBLANK(E1)", False), ("=TYPE(A1:A3)", 64.0), ("=AND(A1:A3)", True), ("=OR(B1,TRUE)", Err("#VALUE!")), ("=CONCAT(A1:B2)", "3x1y"), ("=TEXTJOIN(\"-\",TRUE,E1:E3,A1)", "7-3"), ("=TEXTSPLIT(\"a,b;c\",\",\",\";\")", [["a", "b"], ["c", Err("#N/A")]]),
    ("=TEXTAFTER(\"a-b-c\",\"-\",-1)", "c"), ("=TEXTBEFORE(\"a-b\",\"+\",1,0,1)", "a-b"), ("=TEXTAFTER(\"ab\",\"z\",1,0,0,\"no\")", "no"), ("=TEXT(12345,\"000\")", "12345"), ("=TEXT(1234567,\"#,#00\")", "1,234,567"), ("=TEXT(0.5,\"0.0#%\")", "50.0%"), ("=TEXT(39448,\"dddd d mmm yyyy\")", "Tuesday 1 Jan 2008"), ("=TEXT(1,\"hh:mm\")", Err("#VALUE!")), ("=FIND(\"b\",\"abc\")", 2.0), ("=SEARCH(\"B*\",\"abc\")", 2.0), ("=SUBSTITUTE(\"a-a-a\",\"a\",\"b\",2)", "a-b-a"), ("=REPLACE(\"abcdef\",3,2,\"*\")", "ab*ef"), ("=INT(1E20)", 1e20), ("=LEFT(\"abc\",1E10)", "abc"), ("=1E22&\"\"", "10000000000000000000000"),
    ("=XNPV(0.09,{-10000,2750,4250,3250,2750},{39448,39508,39751,39859,39904})", 2086.6476020315354), ("=ROUND(XIRR({-10000,2750,4250,3250,2750},{39448,39508,39751,39859,39904}),8)", 0.37336253), ("=ROUND(IRR({-70000,12000,15000,18000,21000,26000}),6)", 0.086631), ("=ROUND(XIRR({-386697.56,73919.63,80726.25},{0,257,1814}),5)", -0.23097),
]


@pytest.mark.parametrize(("formula", "want"), CASES)
def test_formula(formula, want):
    got = engine().evaluate(formula)
    assert alike(want, got), got


def test_place_of_a_formula():
    one = engine()
    assert one.evaluate("=A1:A3", "Sheet1!B2") == 1.0
    assert one.evaluate("=A1:A3+1", "B9") == "#VALUE!"
    assert engine(dynamic=True).evaluate("=A1:A3") == n([3], [1], [2])
    assert engine(date_1904=True).evaluate("=DATE(1904,1,2)") == 1.0


def test_names_cells_and_cycles():
    book = {"A1": {"formula": "=IF(TRUE,1,A1)"}, "B1": {"formula": "=C1"}, "C1": {"formula": "=B1"}, "D1": {"formula": "=IFERROR(B1,5)"}}
    one = engine(book, [{"name": "Twice", "refers_to": "=LAMBDA(x,x*2)"}, {"name": "Spot", "refers_to": "'My sheet'!A1"}, {"name": "Rate", "refers_to": "=1/4"}])
    assert one.evaluate("=twice(SPOT)+Rate") == 84.25
    assert one.compute_cell("A1") == 1.0 and one.compute_cell("B1") == "#CIRCULAR!" and one.compute_cell("Sheet1!D1") == 5.0
    assert one.compute_named("Spot") == 42.0 and one.compute_range("'My sheet'!A1:B1") == [[42.0, None]]
    assert one.evaluate("=nothing") == "#NAME?" and Engine(Workbook()).evaluate("=A1") is None


def test_long_chains_of_cells():
    cells = {"A1": 1} | {f"A{k}": {"formula": f"=A{k - 1}+1"} for k in range(2, 20001)}
    one = engine(cells)
    assert one.evaluate("=A20000") == 20000.0
    assert one.compute_cell("A20000") == 20000.0
    doubled = {"A1": 1} | {f"A{k}": {"formula": f"=A{k - 1}+A{k - 1}"} for k in range(2, 60)}
    assert engine(doubled).recalculate()["Sheet1", 58, 0] == 2.0**58


def test_references_and_bad_text():
    assert parse_ref("'a''b'!$B$3:A1") == parse_ref("'a''b'!A1:B3") and column_letters(column_number("XFD")) == "XFD"
    for bad in ("=1+", "=(1", "={1,2", "=SUM(1;2)", "=#WHAT"):
        with pytest.raises(FormulaError):
            parse(bad)


def test_values_in_and_out():
    for x in (None, 1.5, "a", True, Err("#N/A"), [[1.0, None]]):
        assert alike(decode(json.loads(json.dumps(encode(x)))), x)
    assert judge(json.dumps({"id": "x", "formula": "=1+", "expected": 1}))[0] == "error"
    assert judge(json.dumps({"id": "x", "formula": "=1", "expected": 2}))[0] == "fail"


def test_case_files(spark, tmp_path, capsys):
    cases = [{"id": "one", "tags": ["t"], "formula": "=1+1", "expected": {"number": 2}}, {"id": "two", "formula": "=1", "expected": 2}, {"id": "three", "formula": "=NOW()", "ignore": "volatile"}]
    (tmp_path / "list.json").write_text(json.dumps(cases[:2]))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "some.json").write_text(json.dumps({"cases": cases[2:]}))
    (tmp_path / "schema.json").write_text("{}")
    found = {r["case_id"]: r["verdict"] for r in verdicts(read_cases(spark, str(tmp_path))).collect()}
    assert found == {"one": "pass", "two": "fail", "three": "ignored"}
    assert main(["--corpus", str(tmp_path)]) == 1 and "fail two" in capsys.readouterr().out
    assert main(["--corpus", str(tmp_path), "--tag", "t", "--format", "json"]) == 0
    assert main(["--corpus", str(tmp_path), "--id", "none"]) == 2


@pytest.mark.skipif(not os.path.isdir(CASES_DIR), reason="no case files")
def test_corpus(spark):
    bad = verdicts(read_cases(spark, CASES_DIR)).where("verdict NOT IN ('pass', 'ignored')").collect()
    assert not bad


def test_formulas_of_rows(spark):
    book = json.dumps({"sheets": [{"name": "S", "cells": {"A1": 2, "A2": {"formula": "=A1*3"}}}]})
    rows = [(1, "=A1+A2", book), (2, "=A1", None), (3, None, book), (4, "=1+", book), (5, "=A1", "{"), (6, "=" + "(" * 9000 + "1" + ")" * 9000, book), (7, "=SORT(A1:A2,1,-1)", book)]
    got = {r["id"]: r["value"] for r in formulas(spark.createDataFrame(rows, "id int, f string, b string"), "f", "b").collect()}
    want = {1: {"number": 8.0}, 2: {"empty": None}, 3: None, 4: {"error": "#NAME?"}, 5: {"error": "#REF!"}, 6: {"error": "#VALUE!"}, 7: {"array": [[{"number": 6.0}], [{"number": 2.0}]]}}
    assert {k: v and json.loads(v) for k, v in got.items()} == want
