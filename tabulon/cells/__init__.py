"""The cell lane: formulas over workbooks, evaluated where each workbook is.

Cells are of mixed types, arrays change their shape with their values, and branches that are not
taken must not be visited, so a workbook is evaluated by an interpreter; many workbooks are
rows of a DataFrame that executors work on side by side. Table-scale work on typed columns
belongs to ``tabulon.plans`` and ``tabulon.operators``, which compile to Spark expressions.
"""
