"""The queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name to its module; each module has query(spark, sf_dir) and ORACLE_SQL (None: not expressible).
MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_language_id": "language_id",
    "op3_class_lm": "class_lm",
    "op4_code_search": "code_search",
    "op5_token_counts": "token_counts",
    "op6_byte_bpe": "byte_bpe",
    "op7_warc_archive": "warc_archive",
    "op8_license_scan": "license_scan",
    "op9_near_dup": "near_dup",
    "op10_best_fit_packing": "packing",
}


def _module(name: str):
    return importlib.import_module(f"tabulon.llm.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in MODULES} | {"quality_base_counts": _module("op1_quality_rules").base_counts}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := _module(name).ORACLE_SQL)} | {"quality_base_counts": _module("op1_quality_rules").BASE_SQL}
