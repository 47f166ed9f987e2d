"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; :mod:`tallyspark.llm.queries` wires them to the tables.
"""
