"""Worksheet functions as Spark Column expressions."""
