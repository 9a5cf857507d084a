"""Relational operators: DataFrames to DataFrames."""
