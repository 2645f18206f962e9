"""Strandline: similarity search and time-series mining on Spark DataFrames."""
