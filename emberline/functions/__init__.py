"""Expressions of the rule language as Spark columns and as plain Python."""
