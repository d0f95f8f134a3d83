"""Operators that keep working on streaming DataFrames."""
