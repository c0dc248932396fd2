"""Measurement-invariance analytics on Spark DataFrames."""
