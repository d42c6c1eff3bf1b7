"""Quirewise: manuscript and text analytics on Spark DataFrames."""
