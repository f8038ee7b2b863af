"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, reads whole texts, and states in its docstring what happens to
nulls, empty texts, repeated rows and empty tables.
"""
