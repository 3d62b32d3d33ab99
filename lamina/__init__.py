"""Columnar layout and encoding analytics on Spark DataFrames."""
