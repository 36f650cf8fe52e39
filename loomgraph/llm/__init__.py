"""Operators for preparing training text at corpus scale.

Nothing else in the package imports this subpackage.  Every operator takes and returns DataFrames,
has its own module, and states in its docstring what it does with nulls, empty and very long texts,
ties, repeated rows, empty tables and extra columns.
"""
