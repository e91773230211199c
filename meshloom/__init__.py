"""Geometric-graph analytics on Spark DataFrames."""
