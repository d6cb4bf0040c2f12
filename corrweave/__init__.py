"""Condition-dependent association networks on Spark DataFrames."""
