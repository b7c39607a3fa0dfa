"""Operators: each takes DataFrames and returns a DataFrame, and runs nothing by itself."""
