"""Inversion, statistics, search and explanation on DataFrames."""
