"""Computing cases and comparing them with what is expected, as DataFrames; text and JSON reports; a command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

import tabulon.cells.arrays
import tabulon.cells.finance
import tabulon.cells.scalars  # noqa: F401
from tabulon.cells import values as V
from tabulon.cells.evaluator import Evaluator, Workbook, at_cell
from tabulon.cells.values import Err
from tabulon.plans.parser import FormulaError, Node, Ref, parse_ref
from tabulon.sources.cases import CASES, decode, encode, read_cases, workbook

VERDICTS = "file string, case_id string, tags array<string>, verdict string, expected string, got string"


class Engine:
    """Formulas, cells and names of one workbook."""

    def __init__(self, book: Workbook, *, date_1904: bool = False, dynamic: bool = False, seed: int | None = None) -> None:
        self.book, self.options = book, {"date_1904": date_1904, "dynamic": dynamic, "seed": seed}

    def evaluate(self, formula: str, at: str | None = None) -> object:
        """The value of a formula as if it stood in a cell (by default A1 of the first sheet)."""
        sheet, host = at_cell(at)
        return V.tidy(Evaluator(self.book, sheet, host, **self.options).formula(formula))

    def compute_cell(self, place: str) -> object:
        sheet, spot = at_cell(place)
        ev = Evaluator(self.book, sheet, spot, **self.options)
        ev.prepare(Node("ref", parse_ref(place)))
        return V.tidy(ev.cell(sheet, *spot))

    def compute_named(self, name: str) -> object:
        return V.tidy(Evaluator(self.book, **self.options).named(name))

    def compute_range(self, place: str) -> object:
        ref = parse_ref(place)
        ev = Evaluator(self.book, ref.sheet, (ref.top, ref.left), **self.options)
        ev.prepare(Node("ref", ref))
        return ev.range(ref)

    def recalculate(self) -> dict[tuple[str, int, int], object]:
        """The value of every formula cell."""
        out = {}
        ev = Evaluator(self.book, **self.options)
        for sheet in self.book.sheets:
            for row, column in sheet.formulas:
                ev.prepare(Node("ref", Ref(sheet.name, row, column, row, column)))
                out[sheet.name, row, column] = V.tidy(ev.cell(sheet.name, row, column))
        return out


def compute(case: dict) -> object:
    """The value that a case asks for."""
    options = case.get("options") or {}
    engine = Engine(
        workbook(case.get("workbook")),
        date_1904=options.get("date_system") == "excel1904",
        dynamic=options.get("array_mode") == "dynamic-array",
        seed=options.get("rng_seed"),
    )
    if case.get("cell"):
        return engine.compute_cell(case["cell"])
    if case.get("named"):
        return engine.compute_named(case["named"])
    return engine.evaluate(case["formula"], case.get("at"))


def alike(a: object, b: object) -> bool:
    """Of one type, numbers equal at 15 digits, texts exactly, arrays cell by cell."""
    if isinstance(a, list) or isinstance(b, list):
        return isinstance(a, list) and isinstance(b, list) and len(a) == len(b) and all(len(r) == len(s) and all(map(alike, r, s)) for r, s in zip(a, b, strict=True))
    if isinstance(a, float) and isinstance(b, float):
        return V.same_number(a, b)
    return type(a) is type(b) and a == b


def judge(body: str) -> tuple[str, str | None, str | None]:
    """Verdict (pass, fail, error or ignored), expected and found value of one case."""
    case = json.loads(body)
    if case.get("ignore"):
        return "ignored", None, None
    want = decode(case.get("expected"))
    try:
        got = compute(case)
    except (FormulaError, RecursionError, ArithmeticError, ValueError, TypeError, LookupError, AttributeError) as bad:
        return "error", json.dumps(encode(want)), f"{type(bad).__name__}: {bad}"
    return "pass" if alike(want, got) else "fail", json.dumps(encode(want)), json.dumps(encode(got))


def verdicts(cases: DataFrame) -> DataFrame:
    """One row a case; cases are independent, so executors work on them side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[judge(b) for b in batch.column(4).to_pylist()], strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, pa.string()) for c in found]], names=[c.split()[0] for c in VERDICTS.split(", ")])

    return cases.select(*[c.split()[0] for c in CASES.split(", ")]).mapInArrow(run, VERDICTS)


def formulas(frame: DataFrame, formula: str, book: str, *, out: str = "value") -> DataFrame:
    """A frame of (formula, workbook as JSON) rows with the value of each as JSON in ``out``.

    A null formula gives null, a null workbook is an empty one; text that is no formula is #NAME?, a
    workbook that is none #REF!, and a formula nested too deep to be read #VALUE!.
    """
    schema = StructType([*frame.schema.fields, StructField(out, StringType())])
    at = (frame.columns.index(formula), frame.columns.index(book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, data in zip(*[batch.column(k).to_pylist() for k in at], strict=True):
                made.append(None if text is None else json.dumps(encode(_evaluated(text, data))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, out])

    return frame.mapInArrow(run, schema)


def _evaluated(text: str, data: str | None) -> object:
    try:
        book = workbook(json.loads(data) if data else None)
    except (ValueError, TypeError, LookupError, AttributeError):
        return Err(V.REF)
    try:
        return Engine(book).evaluate(text)
    except FormulaError:
        return Err(V.NAME)
    except RecursionError:
        return Err(V.VALUE)


def by_file(judged: DataFrame) -> DataFrame:
    """Cases of each verdict by file."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v if v != "error" else "failed_to_run")
    return judged.groupBy(F.regexp_extract("file", r"([^/]+/[^/]+)\.json$", 1).alias("file")).agg(*[count(v) for v in ("pass", "fail", "error", "ignored")])


def main(arguments: list[str] | None = None) -> int:
    """Exit code 0 if every case passes, 1 if one does not, 2 if nothing could be run."""
    options = argparse.ArgumentParser(prog="python -m tabulon.plans.verify")
    options.add_argument("--corpus", required=True)
    options.add_argument("--format", choices=("text", "json"), default="text")
    options.add_argument("--output")
    options.add_argument("--tag", action="append", default=[])
    options.add_argument("--id", action="append", default=[])
    options.add_argument("--list-ids", action="store_true")
    options.add_argument("--list-tags", action="store_true")
    given = options.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    cases = read_cases(spark, given.corpus)
    if given.tag:
        cases = cases.where(F.arrays_overlap("tags", F.lit(given.tag)))
    if given.id:
        cases = cases.where(F.col("case_id").isin(given.id))
    if given.list_ids or given.list_tags:
        column = F.col("case_id") if given.list_ids else F.explode("tags")
        lines = [r[0] for r in cases.select(column.alias("x")).distinct().orderBy("x").collect()]
        report = "\n".join(lines)
        code = 0
    else:
        rows = verdicts(cases).orderBy("case_id").collect()
        if not rows:
            print("no case", file=sys.stderr)
            return 2
        count = {v: sum(r["verdict"] == v for r in rows) for v in ("pass", "fail", "error", "ignored")}
        bad = [r for r in rows if r["verdict"] in ("fail", "error")]
        code = 1 if bad else 0
        if given.format == "json":
            report = json.dumps({"counts": count, "failures": [{"id": r["case_id"], "verdict": r["verdict"], "expected": r["expected"], "got": r["got"]} for r in bad]})
        else:
            report = "\n".join([*[f"{r['verdict']} {r['case_id']}: expected {r['expected']}, got {r['got']}" for r in bad], ", ".join(f"{n} {v}" for v, n in count.items())])
    if given.output:
        with open(given.output, "w", encoding="utf-8") as file:
            file.write(report + "\n")
    else:
        print(report)
    return code


if __name__ == "__main__":
    sys.exit(main())
