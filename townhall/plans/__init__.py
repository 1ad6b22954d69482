"""Composed analyses: each takes and returns DataFrames."""
