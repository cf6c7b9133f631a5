"""Narrow operators on streaming DataFrames."""
