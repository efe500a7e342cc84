"""Tidemark: panels of time series, market states and portfolio studies as Spark plans."""
