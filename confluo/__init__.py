"""Gridded rainfall fusion on Spark: DataFrame operators over a long (product, cell, day, value) table."""
