"""Operators on long panels: DataFrames in, DataFrames out."""
