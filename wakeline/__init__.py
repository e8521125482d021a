"""Vessel-movement analytics on Spark DataFrames."""
