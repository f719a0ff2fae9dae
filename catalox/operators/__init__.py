"""Operators over record collections: DataFrames in, DataFrames out."""
