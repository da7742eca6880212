"""Data-processing operators that work on plain DataFrames."""
