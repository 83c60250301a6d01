"""Nested-data analytics for PySpark."""
