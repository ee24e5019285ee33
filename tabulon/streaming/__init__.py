"""Criteria aggregates and formulas over streams of rows."""
