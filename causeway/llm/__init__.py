"""Operators for preparing text corpora: each takes and returns DataFrames."""
