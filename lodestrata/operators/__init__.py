"""Operators on mutations; each takes and returns DataFrames and does no I/O."""
