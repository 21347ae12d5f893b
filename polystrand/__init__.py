"""Elastic-degenerate string analytics on Spark DataFrames."""
