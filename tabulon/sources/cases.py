"""Cases: a formula, cell or name to compute over a small workbook, with the value expected.

A case file is JSON: one case, a list of cases, or an object with a list ``cases``. Values are a
one-key object (number, text, bool, error, empty, array) or a bare literal; a bare text that starts
with # is an error. Files are read on the executors, one row a file, and leave one row a case.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabulon.cells.evaluator import Sheet, Workbook
from tabulon.cells.values import Err
from tabulon.plans.parser import parse_cell

CASES = "file string, case_id string, tags array<string>, ignore string, body string"


def decode(x: object) -> object:
    """A cell value from its JSON form."""
    if isinstance(x, dict):
        if "array" in x:
            return [[decode(c) for c in row] for row in x["array"]]
        if "error" in x:
            return Err(x["error"])
        if "empty" in x:
            return None
        if "number" in x:
            return float(x["number"])
        return x["text"] if "text" in x else x.get("bool")
    if isinstance(x, list):
        return [[decode(c) for c in row] for row in x]
    if isinstance(x, str):
        return Err(x) if x.startswith("#") else x
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x


def encode(x: object) -> object:
    """The JSON form of a cell value."""
    if isinstance(x, list):
        return {"array": [[encode(c) for c in row] for row in x]}
    if isinstance(x, Err):
        return {"error": str(x)}
    if x is None:
        return {"empty": None}
    return {"bool": x} if isinstance(x, bool) else {"number": x} if isinstance(x, float) else {"text": x}


def workbook(data: dict | None) -> Workbook:
    """The workbook of a case; a formula cell keeps no stored value."""
    book = Workbook()
    for one in (data or {}).get("sheets") or []:
        sheet = Sheet(one["name"])
        for place, cell in (one.get("cells") or {}).items():
            at = parse_cell(place)
            if isinstance(cell, dict) and ("formula" in cell or "value" in cell):
                if cell.get("formula"):
                    sheet.formulas[at] = cell["formula"]
                elif cell.get("value") is not None:
                    sheet.values[at] = decode(cell["value"])
            else:
                sheet.values[at] = decode(cell)
        book.sheets.append(sheet)
    for name in (data or {}).get("names") or []:
        book.names[name["name"].lower()] = name["refers_to"]
    return book


def _cases(text: str) -> list[dict]:
    data = json.loads(text)
    if isinstance(data, dict):
        data = data["cases"] if "cases" in data else [data]
    return data


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of every JSON file below ``path``; files named schema.json hold none."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    texts = files.text(path, wholetext=True).selectExpr("_metadata.file_path AS file", "value").where("file NOT LIKE '%/schema.json'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(file, c["id"], c.get("tags") or [], c.get("ignore"), json.dumps(c)) for c in _cases(text)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CASES.split(", ")])

    return texts.mapInArrow(run, CASES)
