"""Paired-signal analytics on Spark DataFrames."""
