"""Relational operators of trace analysis; each takes and returns DataFrames."""
