"""Operators on DataFrames. Every operator that depends on order takes the order explicitly."""
