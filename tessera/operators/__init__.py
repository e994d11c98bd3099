"""Operators: pure functions from DataFrames to DataFrames, and column expressions."""
