"""Snapshot and flow analytics on Spark DataFrames."""
