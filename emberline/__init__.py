"""Behavioural event detection and training-data operators on Spark DataFrames."""
