"""Operators: each takes DataFrames and returns a DataFrame; none triggers a job unless its docstring says so."""
