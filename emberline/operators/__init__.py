"""Operators over event DataFrames."""
