"""Operators over DataFrames: each takes tables and column names and returns a table."""
