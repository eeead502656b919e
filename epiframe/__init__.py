"""Operators for health and neuroscience event tables on Spark DataFrames."""
