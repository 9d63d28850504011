"""Operators on long tables: DataFrames in, DataFrames out, with the columns named by arguments."""
