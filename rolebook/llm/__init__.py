"""Operators of a training-data pipeline: one module for each operator.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame with an id and a text column, ignores all other columns (so a table
may carry columns of any name), and states in its docstring what nulls, empty
texts, ties and repeated rows give.
"""
